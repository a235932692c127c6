"""Line-first quality rules.

Every line that holds a word is judged by three rules (punctuation, navigation,
boilerplate). Failing lines are removed; a document that loses more than
`max_lost_pct` percent of its words, or fails the base rules, is rejected.
All work happens inside the row with SQL functions: no shuffle, whatever the
size or skew of the sources.

Defined cases: null and empty texts have no words, fail the base rules and are
rejected; repeated rows are judged alike; other columns of the input are passed
through by `apply_rules` and cannot clash, since derived columns are built in
one struct column named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, WORD_RE, let, text_or_empty

WINDOW = 8
# A mark run: symbols, or two and more exclamation or question marks.
MARKS_RE = r"[#*$%&|<>{}~^_=\\]+|[!?]{2,}"
TERMINAL_RE = r"""[.!?:;,…。！？"'”’»)\]][\x20\x09-\x0D]*$"""
MARKED_RE = r"[#*$%&|<>{}~^_=\\»·•/]|[!?]{2}"  # any text with a mark run or a separator holds this
SEPARATOR_RE = r"(?:^|[\x20\x09])[|>»·•/][\x20\x09]"
BOILERPLATE_RE = (r"(?i)\b(?:enable javascript|javascript is (?:disabled|required)|cookie (?:policy|settings)|"
                  r"we use cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|lorem ipsum|"
                  r"click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:on|this)|skip to content|"
                  r"back to top|all rights reserved)\b")


def repeated_words(words: Column) -> Column:
    """Number of words inside 8-word windows that occur twice or more, first occurrences included."""

    def paired(h, k):  # hash of the elements i and i + k
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k),
                          lambda a, b: F.xxhash64(a, b))

    def repeats(g):
        return F.size(F.array_distinct(g)) < F.size(g)

    def covered(w):
        # A repeated 8-word window repeats its 4-word windows: most texts end there.
        fours = let(paired(w, 1), lambda h2: paired(h2, 2))
        found = let(fours, lambda h4: F.when(repeats(h4), let(paired(h4, 4), lambda g: F.when(
            repeats(g), spread(w, g)))))
        return F.when(F.size(w) > WINDOW, F.coalesce(found, F.lit(0))).otherwise(F.lit(0))

    def spread(w, grams):
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), (i + 1).alias("i"))))

        def same(a, b):  # equal hashes are confirmed on the words themselves
            return F.coalesce((a["g"] == b["g"]) & (F.slice(w, a["i"], WINDOW) == F.slice(w, b["i"], WINDOW)), F.lit(False))

        found = let(ordered, lambda s: F.filter(
            F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])),
            lambda i: i.isNotNull()))
        far = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(F.array_sort(found), far, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return let(words, covered)


def line_fault(line: Column, marked: Column) -> Column:
    """Name of the first rule that a line fails, or null. marked: whether the text holds any MARKED_RE."""
    words = F.regexp_count(line, F.lit(WORD_RE))
    marks = F.regexp_count(line, F.lit(MARKS_RE))
    separators = F.regexp_count(line, F.lit(SEPARATOR_RE))
    dense = F.when(marked, let(F.struct(words.alias("words"), marks.alias("marks"), separators.alias("separators")), lambda c: (
        F.when((c["marks"] * 100 > c["words"] * 20) & (c["separators"] * 100 <= c["words"] * 20), "punctuation")
        .when((c["separators"] >= 2) & (c["separators"] * 100 > c["words"] * 20), "navigation"))))
    return F.coalesce(dense, F.when(line.rlike(_fewer_words(5)) & ~line.rlike(TERMINAL_RE), "navigation")
                      .when(line.rlike(_fewer_words(25)) & line.rlike(BOILERPLATE_RE), "boilerplate"))


def _fewer_words(n: int) -> str:
    """Pattern of lines with fewer than n words; possessive, so that long lines fail early."""
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return f"^{gap}*+(?:{word}++{gap}++){{0,{n - 2}}}+(?:{word}*+){gap}*+\\z"


def judged(text: Column, max_lost_pct: int = 30) -> Column:
    """Struct of the base counts, the words lost to each rule, the verdict and the cleaned text."""
    # Java drops no empty trailing lines with a limit of -1.
    lines = F.split(text, "\n", -1)
    words = F.filter(F.split(text, SPACE_RE + "+", -1), lambda x: x != "")
    worded = F.filter(lines, lambda x: x.rlike(WORD_RE))
    counts = let(F.struct(words.alias("w"), text.rlike(MARKED_RE).alias("marked")), lambda t: F.struct(
        F.size(t["w"]).cast("long").alias("n_words"),
        F.char_length(F.array_join(t["w"], "")).cast("long").alias("word_chars"),
        F.when(t["marked"], F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).otherwise(0).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(t["w"]).cast("long").alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), line_fault(x, t["marked"]).alias("fault"))).alias("lines")))

    def verdict(c):
        def lost(rule):
            return F.aggregate(c["lines"], F.lit(0), lambda a, x: a + F.when(
                F.coalesce(x["fault"] == rule, F.lit(False)), F.regexp_count(x["line"], F.lit(WORD_RE))).otherwise(0))

        failed = (c["n_words"] < 20) | (c["n_repeat_words"] * 100 > c["n_words"] * 30)
        rules = F.struct(*[lost(r).cast("long").alias(f"lost_{r}") for r in ("punctuation", "navigation", "boilerplate")])
        return let(rules, lambda r: F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            (~failed & ((r["lost_punctuation"] + r["lost_navigation"] + r["lost_boilerplate"]) * 100
                        <= c["n_words"] * max_lost_pct)).alias("kept"),
            *[r[k].alias(k) for k in ("lost_punctuation", "lost_navigation", "lost_boilerplate")],
            F.array_join(F.transform(F.filter(c["lines"], lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n")
            .alias("clean_text")))

    return let(counts, verdict)


def apply_rules(docs: DataFrame, name: str = "rules", max_lost_pct: int = 30) -> DataFrame:
    """docs with one more struct column (see `judged`)."""
    return docs.withColumn(name, judged(text_or_empty(), max_lost_pct))


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", judged(text_or_empty()).alias("r"))
    return rows.select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words",
                       "r.base_failed", "r.kept", "r.lost_punctuation", "r.lost_navigation", "r.lost_boilerplate")


def keep_clean(docs: DataFrame) -> DataFrame:
    """Pipeline stage: kept documents with their failing lines removed; columns as in the input."""
    rows = docs.select(*[c for c in docs.columns if c not in ("text", "n_chars")],
                       judged(text_or_empty()).alias("r")).where("r.kept")
    made = {"text": F.col("r.clean_text"), "n_chars": F.char_length("r.clean_text").cast("long")}
    return rows.select(*[made[c].alias(c) if c in made else c for c in docs.columns])


_FAULT_SQL = f"""
  CASE WHEN marks * 100 > words * 20 AND seps * 100 <= words * 20 THEN 'punctuation'
       WHEN seps >= 2 AND seps * 100 > words * 20 THEN 'navigation'
       WHEN words < 5 AND NOT regexp_matches(line, '{TERMINAL_RE.replace("'", "''")}') THEN 'navigation'
       WHEN words < 25 AND regexp_matches(line, '{BOILERPLATE_RE}') THEN 'boilerplate' END"""

ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS all_lines
  FROM documents),
grams AS (
  SELECT doc_id, w, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS t(i)),
found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM found, range(0, 8) AS t(k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(all_lines) AS line FROM d),
measured AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{WORD_RE}')) AS words,
         len(regexp_extract_all(line, '{MARKS_RE}')) AS marks,
         len(regexp_extract_all(line, '{SEPARATOR_RE}')) AS seps FROM line),
fault AS (SELECT *, {_FAULT_SQL} AS fault FROM measured),
lost AS (
  SELECT doc_id, CAST(coalesce(sum(words) FILTER (fault = 'punctuation'), 0) AS BIGINT) AS lost_punctuation,
         CAST(coalesce(sum(words) FILTER (fault = 'navigation'), 0) AS BIGINT) AS lost_navigation,
         CAST(coalesce(sum(words) FILTER (fault = 'boilerplate'), 0) AS BIGINT) AS lost_boilerplate
  FROM fault GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(text) - len(regexp_extract_all(text, '{SPACE_RE}')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(all_lines, lambda x: regexp_matches(x, '{WORD_RE}')))
              - len(list_distinct(list_filter(all_lines, lambda x: regexp_matches(x, '{WORD_RE}')))) AS BIGINT) AS n_dup_lines
  FROM d),
judged AS (
  SELECT base.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
         lost_punctuation, lost_navigation, lost_boilerplate
  FROM base JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, NOT base_failed AND (lost_punctuation + lost_navigation + lost_boilerplate) * 100 <= n_words * 30 AS kept
FROM judged"""
