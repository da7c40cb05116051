"""Which of many fragments occur in a text: an index of short strings, joined once.

Testing a text for every fragment of every source makes an expression that grows with the
configuration. Here each fragment is filed under one of its own three-letter strings (the one fewest
fragments share; all of it if it is shorter). A text gives the distinct strings of these lengths it
holds, they are looked up in the index in one join, and only fragments found there are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters a fragment is filed under at most.
GRAM = 3


def grams_of(fragment: str) -> list[str]:
    size = min(GRAM, len(fragment))
    return sorted({fragment[k : k + size] for k in range(len(fragment) - size + 1)})


class FragmentIndex:
    """Fragments (in small letters) by kind of text and owner, made from the configuration."""

    def __init__(self, spark: SparkSession, entries: Iterable[tuple[str, str, int]]):
        """``entries``: kind of text, fragment, number of the owner."""
        wanted = sorted({(kind, fragment.lower(), owner) for kind, fragment, owner in entries})
        shared = Counter((k, g) for k, f in {(k, f) for k, f, _ in wanted} for g in grams_of(f))
        rows = [
            (kind, min(grams_of(f), key=lambda g: (shared[kind, g], g)), f, owner)
            for kind, f, owner in wanted
        ]
        self.sizes = sorted({len(row[1]) for row in rows})
        self.table = spark.createDataFrame(rows, "kind string, gram string, fragment string, owner int")

    def _grams(self, text: Column) -> Column:
        def of_size(size: int) -> Column:
            last = F.length(text) - size + 1
            places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(places, lambda k: F.substr(text, k, F.lit(size)))

        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(none, *[of_size(n) for n in self.sizes]))

    def find(self, texts: DataFrame) -> DataFrame:
        """``key, kind, owner, fragment`` of the fragments in texts (``key, kind, text``).

        A text names a fragment of an owner once. The index is as large as the configuration.
        """
        lowered = texts.withColumn("text", F.lower("text"))
        probes = lowered.select("*", F.explode(self._grams(F.col("text"))).alias("gram"))
        near = probes.join(F.broadcast(self.table), ["kind", "gram"])
        return near.filter(F.contains("text", "fragment")).select("key", "kind", "owner", "fragment")
