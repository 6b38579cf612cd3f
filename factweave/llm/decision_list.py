r"""Quality rules: a decision list learned by sequential covering (DataFrame functions only).

``text_stats`` measures whole texts inside the JVM.  ``learn`` grows and
prunes conjunctions of thresholds on labelled statistics; every step is one
grouped count over all labelled rows, of which the driver gets a row per
(feature, bin).  ``DecisionList.verdict`` is an ordered CASE expression.

Defined results: a null text counts as empty; an empty text has zeros
everywhere and fails the base rules; statistics are per row, so repeated rows
repeat; without usable labels (no row, or one class only) the list is empty
and every document that passes the base rules is kept; other columns of the
input are not read, and clash with nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import let, words_of, written

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Features of the rules, each a ratio that does not grow with the text.
FEATURES = {
    "mean_word_chars": lambda s: s("word_chars") / F.greatest(s("n_words"), F.lit(1)),
    "symbols_per_word": lambda s: s("n_symbols") / F.greatest(s("n_words"), F.lit(1)),
    "dup_lines_per_line": lambda s: s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)),
    "repeat_share": lambda s: s("n_repeat_words") / F.greatest(s("n_words"), F.lit(1)),
    "upper_share": lambda s: s("n_upper") / F.greatest(s("word_chars"), F.lit(1)),
    "marks_per_word": lambda s: s("n_marks") / F.greatest(s("n_words"), F.lit(1)),
    "words": lambda s: s("n_words").cast("double"),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _window_hashes(words: Column) -> Column:
    """A hash of each window of WINDOW words, from hashes of 1, 2 and 4 words."""

    def paired(step: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    fours = let(
        let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: paired(1, h)),
        lambda h: paired(2, h),
    )
    eights = let(fours, lambda h: F.slice(paired(4, h), F.lit(1), F.size(words) - (WINDOW - 1)))
    return F.when(F.size(words) >= WINDOW, eights).otherwise(F.array().cast("array<bigint>"))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice in the array."""

    def covered(by_hash: Column) -> Column:
        twins = F.transform(
            by_hash,
            lambda x, j: F.when(
                (F.get(by_hash, j - 1)["h"] == x["h"]) | (F.get(by_hash, j + 1)["h"] == x["h"]), x["p"]
            ),
        )
        places = F.sort_array(F.filter(twins, lambda p: p.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")
            ),
            lambda a: a["total"],
        )

    sorted_pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(sorted_pairs, covered))


def text_stats(text: Column) -> Column:
    """Struct of STATS (longs) of one text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            let(_window_hashes(w), _repeated).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct"))

    def whole(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
        return let(
            F.struct(let(words_of(t), of_words).alias("w"), let(lines, of_lines).alias("l")),
            lambda m: F.struct(
                m["w"]["n_words"].cast("long").alias("n_words"),
                m["w"]["word_chars"].cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (m["l"]["n"] - m["l"]["distinct"]).cast("long").alias("n_dup_lines"),
                m["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
                m["l"]["n"].cast("long").alias("n_lines"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(t, F.lit(r"[!?]")).cast("long").alias("n_marks"),
            ),
        )

    return let(text, whole)


def base_failed(stat) -> Column:
    """The fixed floor: too few words, or over 30 % of them in repeated windows."""
    return (stat("n_words") < 20) | (100 * stat("n_repeat_words") > 30 * stat("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, stat) -> Column:
        x = FEATURES[self.feature](stat)
        return (x > self.cut) if self.above else (x <= self.cut)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and no rule keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, stat) -> Column:
        """Boolean column: true keeps the document."""
        out = None
        for rule in self.rules:
            hit = _all(rule, stat)
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _all(rule: list[Condition], stat) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(stat)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(
    labelled: DataFrame,
    *,
    bad: Column,
    key: str = "doc_id",
    bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 3,
) -> DecisionList:
    """Learn from rows of STATS columns and the boolean ``bad``; rows with a null label are left out.

    Two thirds of the rows (by a hash of ``key``) grow rules, the rest prunes
    and judges them: a rule stays if, with its prefix that prunes best, at
    least ``min_precision`` of the rows it rejects are bad in both parts.
    """
    feats = list(FEATURES)
    data = labelled.select(
        F.xxhash64(key).alias("k"), *STATS, bad.cast("int").alias("y")
    ).where(F.col("y").isNotNull())
    data = data.select((F.pmod("k", F.lit(3)) < 2).alias("grow"), "y", *[FEATURES[f](F.col).alias(f) for f in feats])
    shares = [i / bins for i in range(1, bins)]
    quantiles = [
        F.percentile_approx(F.when(F.col("y") == y, F.col(f)), shares, 2000).alias(f"{f}_{y}") for f in feats for y in (0, 1)
    ]
    row = data.agg(F.sum("y").alias("bad"), F.count("*").alias("all"), *quantiles).first()
    if not row["bad"] or row["bad"] == row["all"]:
        return DecisionList()
    cuts = {f: sorted({float(v) for y in (0, 1) for v in row[f"{f}_{y}"]}) for f in feats}

    def binned(f: str) -> Column:
        at = F.lit(0)
        for c in cuts[f]:
            at = at + (F.col(f) > c).cast("int")
        return at

    data = written(
        data.select("grow", "y", *feats, *[binned(f).cast("int").alias(f"bin_{f}") for f in feats]), "labelled"
    )
    found = DecisionList()
    plain = {f: (lambda name: F.col(name))(f) for f in feats}

    def holds(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & ((plain[c.feature] > c.cut) if c.above else (plain[c.feature] <= c.cut))
        return out

    def centred(c: Condition, rows: DataFrame) -> Condition:
        """The cut moved to the middle of the gap around it; no row of ``rows`` changes sides."""
        x = plain[c.feature]
        low, high = rows.agg(F.max(F.when(x <= c.cut, x)), F.min(F.when(x > c.cut, x))).first()
        return c if low is None or high is None else Condition(c.feature, c.above, (low + high) / 2)

    rest = data
    while len(found.rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in feats]))
            counts = (
                rest.where("grow").where(holds(rule)).select("y", cells.alias("c"))
                .groupBy("c.f", "c.b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect()
            )
            by: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in feats}
            for r in counts:
                by[r["f"]][r["b"]] = (r["p"], r["n"])
            p0, n0 = (sum(v[i] for v in by[feats[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = None
            for f in feats:
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    x, y = by[f].get(b, (0, 0))
                    p, n = p + x, n + y
                    for cond, (a, z) in ((Condition(f, False, cut), (p, n)), (Condition(f, True, cut), (p0 - p, n0 - n))):
                        if a >= min_covered and (a < p0 or z < n0):
                            g = _gain(a, z, p0, n0)
                            if best is None or g > best[0]:
                                best = (g, cond)
            if best is None or best[0] <= 0:
                break
            rule.append(centred(best[1], rest.where("grow").where(holds(rule))))
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        tallies = rest.groupBy("grow").agg(
            *[F.sum(F.when(holds(r), F.col("y")).otherwise(0)).alias(f"p{i}") for i, r in enumerate(prefixes)],
            *[F.sum(F.when(holds(r), 1 - F.col("y")).otherwise(0)).alias(f"n{i}") for i, r in enumerate(prefixes)],
        ).collect()
        by_part = {bool(t["grow"]): t for t in tallies}

        def score(i: int, part: bool) -> tuple[int, int]:
            t = by_part.get(part)
            return (t[f"p{i}"], t[f"n{i}"]) if t else (0, 0)

        worth = [(p - n) / (p + n) if (p := score(i, False)[0]) + (n := score(i, False)[1]) else -1.0 for i in range(len(rule))]
        keep = max(range(len(rule)), key=lambda i: (worth[i], -i))
        good = all(p + n and p / (p + n) >= min_precision for p, n in (score(keep, True), score(keep, False)))
        if not good:
            break
        found.rules.append(rule[: keep + 1])
        rest = rest.where(~holds(rule[: keep + 1]))
    return found


def with_stats(docs: DataFrame, *, text: str = "text", name: str = "__stats") -> DataFrame:
    """The rows with a struct column of STATS."""
    return docs.withColumn(name, text_stats(F.col(text)))


def stat_of(name: str = "__stats"):
    return lambda s: F.col(f"{name}.{s}")


def labels_joined(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """STATS of the labelled documents that the base rules leave; a document labelled twice counts twice."""
    return stats.where(~base_failed(F.col)).join(
        labels.select("doc_id", F.col("quality").alias("__quality")), "doc_id"
    )


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """Per row of ``docs``: doc_id, STATS, base_failed, kept; and the list that was learned."""
    measured = written(
        with_stats(docs.select("doc_id", "text")).select("doc_id", "__stats.*"), "stats"
    )
    rules = learn(labels_joined(measured, labels), bad=F.col("__quality") == 0, **options)
    out = measured.withColumn("base_failed", base_failed(F.col))
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict(F.col))), rules


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """The rows of ``docs`` that are kept, with their own columns.

    One pass writes each row beside its numbers; learning reads the numbers of
    that table, and the filter its rows, so texts are measured once and never shuffled.
    """
    measured = written(docs.select(F.struct(*docs.columns).alias("row"), text_stats(F.col("text")).alias("stats")), "measured")
    rules = learn(labels_joined(measured.select(F.col("row.doc_id").alias("doc_id"), "stats.*"), labels), bad=F.col("__quality") == 0, **options)
    return measured.where(~base_failed(stat_of("stats")) & rules.verdict(stat_of("stats"))).select("row.*"), rules
