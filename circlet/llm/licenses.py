"""License scans by ordered signature rules, in DataFrame functions only.

Texts are reduced to lower-case words. Documents without any of the stems stop there. For the others, a signature of
`license_rules` runs only if one of its own keywords occurs; matches become intervals, and a match that lies within one
of a rule of the same or higher priority is dropped. Everything happens within a row: no shuffle, no join.

Edge cases: null is the empty text; n_words is 0 and labels are empty without words; first_word and last_word are null
without a base phrase; repeated rows give repeated results; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm.license_rules import FAMILIES, STEMS, rules

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of these is in every text that a phrase or a rule can match; words of a stem may stand any separators apart.
GATE = "(?i)" + "|".join(stem.replace(" ", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+") for stem in STEMS)
#: Matches go into lists of so many at a time, so that the work grows with their number, not its square.
CHUNK = 256


def rule_array() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(label).alias("label"), F.lit(words).alias("words"), F.lit(rx).alias("rx"), F.lit(p).alias("p"), F.lit(s).alias("s")) for n, label, words, rx, p, s in rules()])


def folded(array: str, element: str, state: str, start: str, out: str, after: str) -> str:
    """SQL that goes through `array` (variable x) with a state (fields of acc, at first `start`, then `after`), and appends
    the list `out` of type array<element> at each step; chunk by chunk."""
    names = state.split(", ")
    kept = ", ".join(f"'{n}', i.{n}" for n in names)
    carried = ", ".join(f"'{n}', big.{n}" for n in names)
    none = f"cast(array() as array<{element}>)"
    inner = f"aggregate(slice({array}, c * {CHUNK} + 1, {CHUNK}), named_struct({carried}, 'out', {none}), (acc, x) -> named_struct({after}, 'out', concat(acc.out, {out})))"
    step = f"transform(array({inner}), i -> named_struct({kept}, 'parts', concat(big.parts, array(i.out))))[0]"
    return f"aggregate(sequence(0, cast(greatest(ceil(size({array}) / {CHUNK}), 1) as int) - 1), named_struct({start}, 'parts', cast(array() as array<array<{element}>>)), (big, c) -> {step}, big -> flatten(big.parts))"


#: Characters a to -z of `line`, words w to e.
MATCH = "struct<a:int,z:int,p:int,n:int,label:string,s:double,w:int,e:int>"
SPACES = "(length({0}) - length(replace({0}, ' ', '')))"
INSIDE, BEFORE = SPACES.format("x['1']"), SPACES.format("x['0']")
#: Matches of the rules whose keyword occurs, as intervals (a, -z) of the text `line`: pieces and matches alternate.
FOUND = "flatten(transform(filter(rules, r -> exists(r.words, w -> contains(line, w)) and regexp_like(line, r.rx)), r -> transform(array(arrays_zip(split(line, r.rx, -1), regexp_extract_all(line, r.rx, 0))), zipped -> " + folded(
    "zipped", MATCH, "at, sp", "'at', 0, 'sp', 0",
    "if(x['1'] is null, cast(array() as array<" + MATCH + ">), array(named_struct('a', acc.at + length(x['0']), 'z', -(acc.at + length(x['0']) + length(x['1'])), 'p', r.p, 'n', r.n, 'label', r.label, 's', r.s, 'w', acc.sp + " + BEFORE + " - 1, 'e', acc.sp + " + BEFORE + " - 1 + " + INSIDE + ")))",
    "'at', acc.at + length(x['0']) + coalesce(length(x['1']), 0), 'sp', acc.sp + " + BEFORE + " + coalesce(" + INSIDE + ", 0)",
) + ")[0]))"
#: In order of start, longer first, a match is dropped if one of at least its priority reaches as far.
KEPT = folded(
    "sorted", MATCH, "ends", f"'ends', array_repeat(0, {len(FAMILIES)})",
    "if(array_max(slice(acc.ends, 1, x.p)) >= -x.z, cast(array() as array<" + MATCH + ">), array(x))",
    "'ends', transform(acc.ends, (e, i) -> if(i + 1 = x.p, greatest(e, -x.z), e))",
)


def detected(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, spaced and line (the text's words two and one spaces apart, null without a
    stem), kept: matches left over, as intervals of line."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, "  "))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(F.rlike(text, F.lit(GATE)), F.concat(F.lit("  "), lowered, F.lit("  "))).alias("spaced"))
    rows = rows.select("*", F.replace("spaced", F.lit("  "), F.lit(" ")).alias("line"), rule_array().alias("rules"))
    rows = rows.select("*", F.when(F.col("line").isNotNull(), F.array_sort(F.expr(FOUND))).alias("sorted"))
    return rows.select("doc_id", "n_words", "spaced", "line", F.when(F.size("sorted") > 0, F.expr(KEPT)).alias("kept"))


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, label, rule (its number), score, first_word and last_word (words from 0) of every match left over."""
    # Outer, since the filter that an inner one implies would work the matches out again.
    rows = detected(docs).select("doc_id", F.explode_outer("kept").alias("m")).where("m is not null")
    return rows.select("doc_id", F.col("m.label").alias("label"), F.col("m.n").alias("rule"), F.col("m.s").alias("score"), F.col("m.w").cast("long").alias("first_word"), F.col("m.e").cast("long").alias("last_word"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = detected(docs)
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        mark, n = F.lit(" " + phrase.replace(" ", "  ") + " "), len(phrase.split())
        has = F.coalesce(F.contains("spaced", mark), F.lit(False))
        counts.append(F.when(has, ((F.length("spaced") - F.length(F.replace("spaced", mark, F.lit("")))) / F.length(mark)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(has, F.regexp_count(F.substring_index("spaced", " " + phrase.replace(" ", "  ") + " ", 1), F.lit("[^ ]+"))))
        lasts.append(F.when(has, F.col("n_words") - n - F.regexp_count(F.substring_index("spaced", " " + phrase.replace(" ", "  ") + " ", -1), F.lit("[^ ]+"))))
        names.append(F.when(has, F.lit(label)))
    rows = rows.select("*", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*names)).alias("base"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("kept", lambda x: x["label"]), F.expr("cast(array() as array<string>)")))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("kept", lambda x: x["s"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
