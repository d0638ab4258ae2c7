"""What differs between an expected and a heard text, and what each difference is worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T

from .canonical import expects_date, expects_time, with_tokens
from .matching import matching_blocks, opcodes
from .written import written

# Short words that recognisers drop or add, and the kinds of tokens that are compared by value.
FUNCTION_WORDS = (
    "a al ante con contra de del desde e el en entre hacia hasta la las lo los mas me mi ni o para por pues que se si sin sobre su sus te tras tu un una unas unos u y ya le les nos es ha he"
).split()
VALUES = "^(num|measure|time|date|ord|code):"
SIMILAR = 0.82


def aligned_tokens(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, expected, heard, a, b: both texts with their canonical tokens (value, begin, end); times and dates are expected where the expected text has them."""
    time, date, no = expects_time(F.col("expected")), expects_date(F.col("expected")), F.lit(False)
    # the expected text is written: only the heard one is read with spoken times and dates
    rows = with_tokens(with_tokens(pairs.select(*key, "expected", "heard"), "a", F.col("expected"), no, no), "b", F.col("heard"), time, date)
    token = lambda t, k: F.struct(k.alias("k"), t["value"].alias("value"), t["begin"].alias("begin"), t["end"].alias("end"))
    none = F.array().cast("array<struct<k:int,value:string,begin:int,end:int>>")
    return rows.withColumns({s: F.coalesce(F.transform(s, token), none) for s in "ab"})


def _span(tokens: Column, text: Column, begin: Column, end: Column) -> tuple[Column, Column]:
    """Characters of a range of tokens; an empty one is the place where its words belong."""
    point = F.coalesce(F.get(tokens, begin)["begin"], F.get(tokens, F.size(tokens) - 1)["end"], F.length(text))
    return F.when(begin < end, F.get(tokens, begin)["begin"]).otherwise(point), F.when(begin < end, F.get(tokens, end - 1)["end"]).otherwise(point)


def _digits(values: Column) -> Column:
    """A run of two single digits or more as one number, else null."""
    single = F.forall(values, lambda v: v.rlike("^num:[0-9]$"))
    return F.when((F.size(values) >= 2) & single, F.array_join(F.transform(values, lambda v: F.substring(v, 5, 1)), ""))


def _reads_back(left: Column, right: Column) -> Column:
    """Whether one side says the other's number digit by digit."""
    one = lambda x, y: F.coalesce((F.size(x) == 1) & F.startswith(F.get(x, F.lit(0)), F.lit("num:")) & (F.concat(F.lit("num:"), _digits(y)) == F.get(x, F.lit(0))), F.lit(False))
    return one(left, right) | one(right, left)


def differences(tokens: DataFrame, key: list[str]) -> DataFrame:
    """key, step, kind, expected and heard surface with their characters, values of both sides, expected_tokens: what is not the same."""
    value = lambda s: F.transform(s, lambda t: t["value"])
    # equal texts have no steps but one
    unlike = tokens.select(*key, value("a").alias("a"), value("b").alias("b")).filter("a <> b")
    steps = opcodes(unlike, key).filter("tag <> 'equal'")
    rows = steps.join(tokens, key)
    part = lambda s: F.slice(value(s), F.col(f"{s}_begin") + 1, F.col(f"{s}_end") - F.col(f"{s}_begin"))
    rows = rows.withColumns({"a_values": part("a"), "b_values": part("b"), "expected_tokens": F.size("a")})
    rows = rows.filter(~((F.col("tag") == "replace") & _reads_back(F.col("a_values"), F.col("b_values"))))
    (eb, ee), (hb, he) = (_span(F.col(s), F.col(t), F.col(f"{s}_begin"), F.col(f"{s}_end")) for s, t in (("a", "expected"), ("b", "heard")))
    rows = rows.withColumns({"expected_begin": eb, "expected_end": ee, "heard_begin": hb, "heard_end": he})
    cut = lambda text, b, e: F.when(F.col(e) > F.col(b), F.substring(F.col(text), F.col(b) + 1, F.col(e) - F.col(b))).otherwise("")
    before, after = F.substring(F.col("heard"), F.lit(1), F.col("heard_begin")), F.substring(F.col("heard"), F.col("heard_end") + 1, F.length("heard"))
    rows = rows.withColumns({"missing": cut("expected", "expected_begin", "expected_end"), "said": cut("heard", "heard_begin", "heard_end"), "before": before, "after": after})
    spans = ["expected_begin", "expected_end", "heard_begin", "heard_end"]
    return rows.select(*key, "step", F.col("tag").alias("kind"), "missing", "said", *spans, "before", "after", "a_values", "b_values", "expected_tokens")


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.replace(N.folded(text), F.lit("’"), F.lit("'")), r"\s+"), lambda w: w != "")


def similarity(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, ratio: twice what the blocks of both strings share over their lengths (Ratcliff and Obershelp)."""
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    rows = pairs.select(*key, letters(a).alias("a"), letters(b).alias("b"))
    shared = matching_blocks(rows, key).groupBy(*key).agg(F.sum("size").alias("shared"))
    total = F.size("a") + F.size("b")
    return rows.join(shared, key, "left").select(*key, F.when(total > 0, 2 * F.coalesce("shared", F.lit(0)) / total).otherwise(1.0).alias("ratio"))


def classified(issues: DataFrame, key: list[str]) -> DataFrame:
    """Differences with their type, category (ambiguous_expression or likely_mismatch) and rule."""
    e, h = plain_words(F.col("missing")), plain_words(F.col("said"))
    rows = written(issues.withColumns({"e": e, "h": h, "lead": plain_words(F.col("before")), "tail": plain_words(F.col("after"))}), "differences")
    one_word = rows.filter("kind = 'replace' and size(e) = 1 and size(h) = 1").select(*key, "step", F.get("e", F.lit(0)).alias("x"), F.get("h", F.lit(0)).alias("y"))
    # each two words once, however often they were mixed up
    alike = written(similarity(one_word.select("x", "y").distinct(), ["x", "y"], "x", "y"), "similarity")
    rows = rows.join(one_word.join(alike, ["x", "y"]).select(*key, "step", "ratio"), [*key, "step"], "left")
    e, h, lead, tail, kind = map(F.col, ("e", "h", "lead", "tail", "kind"))
    functional = lambda w: F.forall(w, lambda x: x.isin(*FUNCTION_WORDS))
    span = F.greatest(F.size(e), F.size(h))
    n = F.size(h)
    fragment, following = F.get(h, F.lit(0)), F.get(tail, F.lit(0))
    broken = (n == 1) & (F.length(fragment) >= 2) & ~fragment.isin(*FUNCTION_WORDS) & (following != fragment) & F.startswith(following, fragment)
    last = F.when(F.size(lead) >= n, F.slice(lead, F.greatest(F.size(lead) - n + 1, F.lit(1)), n)).otherwise(lead)
    repeated = (n > 0) & ((h == last) | (h == F.slice(tail, F.lit(1), n)) | F.coalesce(broken, F.lit(False)))
    valued = F.exists(F.concat("a_values", "b_values"), lambda v: v.rlike(VALUES))
    keys = lambda w: F.transform(w, T.sound_key)
    sounds = (F.size(e) > 0) & (keys(e) == keys(h))
    mismatch, ambiguous = "likely_mismatch", "ambiguous_expression"
    rules = [
        ("trailing", mismatch, (kind == "insert") & F.col("after").rlike("^[ .,;:!?¡¿»”\"'…]*$")),
        ("stutter", mismatch, (kind == "insert") & repeated),
        ("function_words", ambiguous, (kind == "replace") & (F.size(e) == 1) & (F.size(h) == 1) & functional(e) & functional(h)),
        ("value", mismatch, valued),
        ("function_word", ambiguous, (span == 1) & kind.isin("delete", "insert") & functional(F.when(F.size(e) > 0, e).otherwise(h))),
        ("same_sound", ambiguous, (kind == "replace") & sounds),
        ("near_homophone", ambiguous, (kind == "replace") & (span == 1) & (F.coalesce("ratio", F.lit(0.0)) >= SIMILAR)),
        ("short_phrase", ambiguous, (span <= 2) & (F.col("expected_tokens") <= 4)),
    ]
    choose = lambda i, other: reduce(lambda c, r: c.when(F.coalesce(r[2], F.lit(False)), r[i]), rules[1:], F.when(F.coalesce(rules[0][2], F.lit(False)), rules[0][i])).otherwise(other)
    rows = rows.withColumns({"rule": choose(0, "wide"), "category": choose(1, mismatch), "span": span})
    kind_of = F.when(F.col("rule") == "stutter", "repetition").when(kind == "delete", "omission").when(kind == "insert", "addition_or_repetition").otherwise("substitution")
    return rows.withColumn("difference", kind_of).drop("e", "h", "lead", "tail", "ratio")


def verdicts(tokens: DataFrame, issues: DataFrame, key: list[str]) -> DataFrame:
    """key, verdict (verified, ambiguous, likely_error), confidence, n_issues of each pair."""
    found = issues.groupBy(*key).agg(F.count("*").alias("n_issues"), F.sum("span").alias("diverged"), F.bool_and(F.col("category") == "ambiguous_expression").alias("soft"))
    rows = tokens.select(*key, F.greatest(F.size("a"), F.lit(1)).alias("n")).join(found, key, "left")
    confidence = F.greatest(F.lit(0.0), 1 - F.coalesce("diverged", F.lit(0)) / F.col("n"))
    verdict = F.when(F.col("n_issues").isNull(), "verified").when(F.col("soft") & (confidence >= 0.5), "ambiguous").otherwise("likely_error")
    return rows.select(*key, verdict.alias("verdict"), confidence.alias("confidence"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def compare(pairs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classified differences and verdicts of pairs (key, expected, heard)."""
    tokens = written(aligned_tokens(pairs, key), "aligned-tokens")
    issues = written(classified(differences(tokens, key), key), "issues")
    return issues, verdicts(tokens, issues, key)
