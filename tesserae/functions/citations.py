"""Citations in answers: links for known numbers, and a list of references for known ids. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number in brackets, perhaps quoted, and an id of twelve hexadecimal digits in brackets.
NUMBER, ID = r"\['?(\d+)'?\]", r"\[([a-f0-9]{12})\]"


def link_numbers(answer: Column, sources: Column) -> Column:
    """``[n]`` as ``[[n]](address)`` where the map ``sources`` has n, else as it stands. One pass: addresses aren't searched."""
    marks = F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0))
    link = lambda n: F.when(sources[n].isNotNull(), F.concat(F.lit("[["), n, F.lit("]]("), sources[n], F.lit(")")))
    put = F.transform(marks, lambda m: F.coalesce(link(F.regexp_replace(m, r"\D", "")), m))
    parts = F.split(answer, NUMBER, -1)
    return F.array_join(F.zip_with(parts, put, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def with_references(answer: Column, sources: Column) -> Column:
    """The answer with a line ``[id] address`` for every cited id that the map ``sources`` has, in the order of ids."""
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(ID), F.lit(1))))
    known = F.filter(cited, lambda i: sources[i].isNotNull())
    lines = F.array_join(F.transform(known, lambda i: F.concat(F.lit("["), i, F.lit("] "), sources[i])), "\n")
    return F.when(F.size(known) > 0, F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\n"), lines)).otherwise(answer)


def source_map(text: Column) -> Column:
    """number -> address from the lines ``[n] address`` of a text; of a number given twice the first address counts."""
    numbers = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]\s*https?://\S+"), F.lit(1))
    urls = F.regexp_extract_all(text, F.lit(r"\[\d+\]\s*(https?://\S+)"), F.lit(1))
    pairs = F.arrays_zip(numbers.alias("n"), urls.alias("u"))
    first = F.filter(pairs, lambda p, i: F.array_position(numbers, p["n"]) == i + 1)
    return F.map_from_entries(F.coalesce(first, F.lit([]).cast("array<struct<n:string,u:string>>")))
