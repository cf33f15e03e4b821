"""Learned quality rules: an ordered list of threshold conjunctions, found by sequential covering.

Native throughout: statistics are column expressions, every growing and pruning
step is one aggregate whose result has at most features x bins rows, and the
learned list is an ordered Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import discard, durable

from .registry import WORD, query

#: Labelled rows that the rules are learned from, drawn by a hash of the id.
FIT_ROWS = 20_000
FEATURES = ("symbol_ratio", "upper_ratio", "mark_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "words_per_line")


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first one included."""

    def covered(windows: Column) -> Column:
        keyed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["w"] == x["w"]
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, F.lit(2), F.size(p)), p, lambda b, a: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)

        return let(let(keyed, places), length)

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(made, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(covered(x)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(windows(w)))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text in a struct ``_q`` beside the document's columns; NULL text has no words."""
    names = [c for c in docs.columns if c != "_q"]
    text = F.coalesce(F.col("_row.text"), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    parts = docs.select(F.struct(*names).alias("_row")).withColumns({
        "_w": let(F.regexp_extract_all(text, F.lit(WORD), 0), counts), "_l": let(worded, line_counts),
        "_s": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "_u": F.regexp_count(text, F.lit("[A-Z]")).cast("long"), "_m": F.regexp_count(text, F.lit("[!?]")).cast("long"),
    })
    chars, words = F.greatest(F.col("_w.word_chars"), F.lit(1)), F.greatest(F.col("_w.n_words"), F.lit(1))
    lines = F.greatest(F.col("_l.n_lines"), F.lit(1))
    q = F.struct(
        "_w.n_words", "_w.word_chars", F.col("_s").alias("n_symbols"), "_l.n_dup_lines", "_w.n_repeat_words",
        (F.col("_s") / chars).alias("symbol_ratio"), (F.col("_u") / chars).alias("upper_ratio"), (F.col("_m") / chars).alias("mark_ratio"), (F.col("_w.n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("_l.n_dup_lines") / lines).alias("dup_line_ratio"), (F.col("_w.word_chars") / words).alias("mean_word"), (F.col("_w.n_words") / lines).alias("words_per_line"),
    )
    return parts.select(*[F.col(f"_row.`{n}`").alias(n) for n in names], q.alias("_q"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, at: str = "_q.") -> Column:
        x = F.col(f"{at}{self.feature}")
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def all_hold(rule, at: str = "_q.") -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(at)
    return out


def verdict(rules, at: str = "_q.") -> Column:
    """The decision list: the first rule that holds rejects; TRUE if none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(all_hold(rule, at), F.lit(False)).otherwise(out)
    return out


def _grid(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Thresholds half-way between neighbouring quantiles of the two classes: rows to the driver are one per class."""
    points = [k / bins for k in range(bins + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).collect()
    out = {}
    for f in FEATURES:
        values = sorted({v for r in found for v in r[f] or []})
        out[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained over the covered bad rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, bins: int = 32, longest: int = 3, most: int = 8, precision: float = 0.98, coverage: int = 5, clean_weight: float = 10.0) -> list[tuple[Condition, ...]]:
    """Rules for bad rows from columns ``_q``, ``bad`` (boolean) and ``_part`` (0, 1 grow; 2 prune).

    A rule grows by the condition of highest information gain until it covers no
    good row of the growing part, loses the conditions at its end that do not
    pay on the pruning part, and is kept if its precision there holds. A good
    row lost weighs as much as ``clean_weight`` bad rows kept. Covered
    rows leave and the next rule starts; the list ends when no rule is kept.
    """
    rows = durable(labelled.select("_q.*", "bad", "_part"))
    grid = _grid(rows, bins)
    tests = [Condition(f, up, t) for f in FEATURES for t in grid[f] for up in (True, False)]
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while tests and len(rules) < most:
        rule: tuple[Condition, ...] = ()
        growing, pruning = left.filter("_part < 2"), left.filter("_part = 2")
        while len(rule) < longest:
            here = growing.filter(all_hold(rule, ""))
            place = lambda f: F.size(F.filter(F.array(*[F.lit(t) for t in grid[f]]) if grid[f] else F.array().cast("array<double>"), lambda t: t < F.col(f)))
            stacked = here.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), place(f).alias("bin")) for f in FEATURES])).alias("_x"))
            table = stacked.groupBy("_x.feature", "_x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            counts = {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in table}
            best, best_gain = None, 1e-9
            for f in FEATURES:
                all_p, all_n = (sum(v[k] for (g, _), v in counts.items() if g == f) for k in (0, 1))
                p = n = 0
                for i, t in enumerate(grid[f]):  # below or at t: bins 0..i
                    a, b = counts.get((f, i), (0, 0))
                    p, n = p + a, n + b
                    for up, (x, y) in ((False, (p, n)), (True, (all_p - p, all_n - n))):
                        if x >= coverage and (g := _gain(x, clean_weight * y, all_p, clean_weight * all_n)) > best_gain:
                            best, best_gain = (Condition(f, up, t), y), g
            if best is None:
                break
            rule += (best[0],)
            if best[1] == 0:
                break
        if not rule:
            break
        heads = [F.struct(F.count_if(F.col("bad") & all_hold(rule[:k], "")).alias("p"), F.count_if(~F.col("bad") & all_hold(rule[:k], "")).alias("n")) for k in range(1, len(rule) + 1)]
        scores = pruning.agg(F.array(*heads).alias("s")).first()["s"]
        value = [((s["p"] - s["n"]) / (s["p"] + s["n"]) if s["p"] + s["n"] else -1.0) for s in scores]
        k = max(range(len(rule)), key=lambda i: (value[i], -i))
        if (value[k] + 1) / 2 < precision:
            break
        rules.append(rule[: k + 1])
        left = left.filter(~all_hold(rules[-1], ""))
    discard(rows)
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[Condition, ...]]:
    """Learn from at most about ``fit_rows`` labelled documents; without labels the list is empty.

    ``labels`` has doc_id and quality (0 is bad); NULLs are left out and the
    lowest of repeated labels counts.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    total = known.count()
    if not total:
        return []
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, fit_rows / total)) or 1))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))
    # size bound: fit_rows in the mean
    both = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return learn(statistics(both).select("_q", (F.col("_quality") == 0).alias("bad"), part.alias("_part")))


def base_failed() -> Column:
    return (F.col("_q.n_words") < 50) | (F.lit(100) * F.col("_q.n_repeat_words") > F.lit(50) * F.col("_q.n_words"))


def judged(docs: DataFrame, rules) -> DataFrame:
    """The documents with ``_q``, ``_base_failed`` and ``_kept``; rows are judged one by one, so copies agree."""
    return statistics(docs).withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & verdict(rules))


@query("op3_quality_rules", "documents", "labels")
def op3(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rule and learned verdict of every document."""
    out = judged(documents.select("doc_id", "text"), fit(documents, labels))
    return out.select("doc_id", "_q.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
