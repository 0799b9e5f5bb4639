"""Keywords and names of a text without a language model: weighted one- and two-word terms, capitalised word groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import italian_tokens
from tesserae.plans.stage import materialize


def terms(words: Column) -> Column:
    """The words, and every two that follow one another."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def tfidf(docs: DataFrame, id_: str, text: str, n: int = 7, diversity: float = 0.0, tokenizer: Callable[[Column], Column] = italian_tokens) -> DataFrame:
    """id, term, weight, rank: the ``n`` terms of each text with the greatest frequency times inverse document frequency.

    With ``diversity`` (0 to 1) terms are taken one after the other, and a term loses that share of its likeness (common
    words) to those taken before; the candidates are then the best 5 * ``n`` of the text. Equal terms are ordered by term.
    """
    rows = docs.select(F.col(id_), F.explode(terms(tokenizer(F.col(text)))).alias("term"))
    counted = materialize(rows.groupBy(id_, "term").agg(F.count("*").alias("tf")), "terms")
    size = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("_n"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.round(F.col("tf") * F.log((1 + F.col("_n")) / (1 + F.col("df"))), 6)
    scored = counted.join(df, "term").join(F.broadcast(size), how="cross").select(id_, "term", weight.alias("weight"))  # one row
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.col("weight").desc(), "term"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= (5 * n if diversity else n))
    if not diversity:
        return best
    kind = dict(best.dtypes)[id_]

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                top = max((x["weight"] for x in items), default=0.0) or 1.0
                left = {x["term"]: x["weight"] / top for x in items}
                weights = {x["term"]: x["weight"] for x in items}
                like = dict.fromkeys(left, 0.0)
                for rank in range(1, min(n, len(left)) + 1):
                    term = min(left, key=lambda t: (-round((1 - diversity) * left[t] - diversity * like[t], 9), t))
                    del left[term]
                    own = set(term.split(" "))
                    for t in left:
                        other = set(t.split(" "))
                        like[t] = max(like[t], len(own & other) / len(own | other))
                    out.append((key, term, weights[term], rank))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.string(), pa.float64(), pa.int32()))], names=[id_, "term", "weight", "rank"])

    packed = best.groupBy(id_).agg(F.collect_list(F.struct("term", "weight")).alias("items"))  # at most 5 n
    return packed.mapInArrow(greedy, f"{id_} {kind}, term string, weight double, rank int")


def entities(text: Column) -> Column:
    """Capitalised words and groups of them, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}'’]+(?: \p{Lu}[\p{L}'’]+)*"), F.lit(0)))
