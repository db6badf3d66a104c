"""Quality rules as a short-circuit cascade.

Each rule rejects a document by itself. Cost and rejections of every rule are estimated on a sample:
costs by rules run so often over it that they outweigh what any job takes, rejections for each
document. The cascade then takes, at each step, the rule with the most rejections per second among
the documents that the rules before have left, and a document leaves at the first rule that rejects
it, so that dear rules see few documents. What is kept doesn't depend on the order.

Defined results
* a null text, or one without words, is rejected.
* rules count over the whole text, however long; thresholds are met exactly, so ties are kept.
* repeated rows are judged each for itself, and a null doc_id is carried along.
* an empty table stays empty; the columns of the input are kept whatever their names.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, only

#: Documents of the sample on which cost and selectivity are estimated.
SAMPLE = 2000
#: Times that a rule runs over the sample when its cost is measured.
REPEATS = 8

WORDS = r"filter(split({t}, '[\\t\\n\\f\\r ]+'), w -> w != '')"
DUCK_WORDS = r"list_filter(regexp_split_to_array({t}, '[\t\n\f\r ]+'), lambda w: w != '')"
#: name -> (SQL of Spark, SQL of DuckDB): true where the rule rejects; {t} is the text, {w} its words.
RULES: dict[str, tuple[str, str]] = {
    "no_words": ("NOT {t} RLIKE '[^\\\\t\\\\n\\\\f\\\\r ]'", r"NOT regexp_matches({t}, '[^\t\n\f\r ]')"),
    "few_letters": (
        "10 * length(regexp_replace({t}, '[^\\\\p{{L}}]+', '')) < 3 * length(regexp_replace({t}, '[\\\\t\\\\n\\\\f\\\\r ]+', ''))",
        r"10 * length(regexp_replace({t}, '[^\pL]', '', 'g')) < 3 * length(regexp_replace({t}, '[\t\n\f\r ]', '', 'g'))",
    ),
    "symbols": (
        "length(translate({t}, '#$%&*|<>~^={{}}', '')) * 100 < length({t}) * 93",
        "length(translate({t}, '#$%&*|<>~^={{}}', '')) * 100 < length({t}) * 93",
    ),
    "exclamations": (
        "(length({t}) - length(replace({t}, '!', ''))) * 4 > size({w})",
        "(length({t}) - length(replace({t}, '!', ''))) * 4 > len({w})",
    ),
    "upper_case": (
        "length(regexp_replace({t}, '[^\\\\p{{Lu}}]+', '')) * 10 > 6 * length(regexp_replace({t}, '[^\\\\p{{L}}]+', '')) AND size({w}) >= 3",
        r"length(regexp_replace({t}, '[^\p{{Lu}}]', '', 'g')) * 10 > 6 * length(regexp_replace({t}, '[^\pL]', '', 'g')) AND len({w}) >= 3",
    ),
    "word_length": (
        "length(regexp_replace({t}, '[\\\\t\\\\n\\\\f\\\\r ]+', '')) > 25 * size({w})",
        r"length(regexp_replace({t}, '[\t\n\f\r ]', '', 'g')) > 25 * len({w})",
    ),
    "repetition": (
        "aggregate({w}, named_struct('n', 0, 'last', ''), (a, x) -> named_struct('n', a.n + if(a.last = x, 1, 0), 'last', x), a -> a.n) * 5 > size({w})",
        "len(list_filter(list_zip(({w})[2:], ({w})[:-2]), lambda x: x[1] = x[2])) * 5 > len({w})",
    ),
}


def rule(name: str, text: str = "text") -> str:
    """A rule as an expression of Spark; null counts as rejection."""
    return "coalesce(" + RULES[name][0].format(t=text, w=WORDS.format(t=text)) + ", true)"


def order_rules(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds for the sample, share rejected of what the rules before leave) in the order of the cascade."""
    docs = only(docs, "text")
    n = docs.count()
    sample = docs.sample(fraction=min(1.0, 1.2 * size / max(n, 1)), seed=11).limit(size) if n > size else docs
    sample = cut(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism))  # a limit leaves one partition
    judged = sample.select(*[F.expr(rule(name)).alias(name) for name in RULES]).collect()
    often = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("k"))

    def seconds(expression: str) -> float:
        best = float("inf")
        for _ in range(2):
            begin = time.perf_counter()
            often.agg(F.sum(F.expr(f"cast({expression} AS bigint)"))).first()
            best = min(best, time.perf_counter() - begin)
        return best

    base = seconds("text IS NULL")
    cost = {name: max(seconds(rule(name)) - base, 1e-4) / REPEATS for name in RULES}
    return cascade(cost, [{name: r[name] for name in RULES} for r in judged])


def cascade(cost: dict[str, float], judged: list[dict[str, bool]]) -> list[tuple[str, float, float]]:
    """Rules by rejections per second among what is left; one that rejects nothing more comes last, the cheaper first."""
    order, left, rest = [], judged, set(cost)
    while rest:
        hits = {name: sum(r[name] for r in left) for name in rest}
        name = min(rest, key=lambda x: (-hits[x] / cost[x], cost[x], x))
        order.append((name, cost[name], hits[name] / max(len(left), 1)))
        rest.remove(name)
        left = [r for r in left if not r[name]]
    return order


def apply_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    for name in order if order is not None else [r[0] for r in order_rules(docs)]:
        docs = docs.filter(F.expr(rule(name)) == F.lit(False))
    return docs


SQL = "SELECT doc_id, n_chars FROM documents WHERE " + " AND ".join(
    "NOT coalesce(" + duck.format(t="text", w=DUCK_WORDS.format(t="text")) + ", true)" for _, duck in RULES.values()
)
