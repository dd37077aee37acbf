"""One surviving record per group of duplicates, chosen bundle by bundle.

Fields that depend on each other form a bundle and survive together. Dependencies bind bundles: two values that are
both chosen must stand together in a record. The choice of greatest summed trust is found by branch and bound: every
bundle's most trusted value bounds what it can add; values that cannot be part of a choice as good as the best one
known are cut off before any branching; the rest extends partial choices level by level, and of partial choices that
agree in what later bundles depend on only the best goes on. Levels are joins, so no group is gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut


@dataclass(frozen=True)
class Bundle:
    """Fields that survive together where ``present``.

    ``trust``: what a record's values add to a choice, 0 or more; a value has the trust of its best record.
    ``order``: what decides between values of equal trust, most important first, larger wins; larger values win last.
    """

    name: str
    fields: tuple[str, ...]
    present: Column
    order: tuple[Column, ...] = ()
    trust: Column | None = None


def _on(group: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in group])


def survivors(df: DataFrame, group: list[str], bundles: list[Bundle], dependencies: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row per group with the fields of the chosen values; null where a bundle has none.

    ``dependencies``: pairs of bundle names whose values, if both are chosen, must stand together in one record.
    Maximises the sum of trust; ties fall to the order of the first bundle, then its larger values, then the second's,
    and so on. Repeated rows change nothing. Groups with a null key are groups. An empty table gives none.
    """
    names = [b.name for b in bundles]
    tied = {n: [x for p in dependencies if n in p for x in p if x != n and names.index(x) < names.index(n)] for n in names}
    bound = {n for p in dependencies for n in p}
    #: Bundles of earlier levels that a later one depends on.
    open_ = [[x for x in names[: i + 1] if any(x in tied[n] for n in names[i + 1 :])] for i in range(len(names))]
    trust = lambda b: F.coalesce((b.trust if b.trust is not None else F.lit(0.0)).cast("double"), F.lit(0.0))
    order = lambda b: [o.alias(f"o{i}") for i, o in enumerate(b.order)] or [F.lit(0).alias("o0")]
    value = lambda b: F.struct(*[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(b.fields)])
    choice = lambda b: F.when(b.present, F.struct(trust(b).alias("t"), F.struct(*order(b)).alias("o"), value(b).alias("v")))
    rows = df.select(*[F.col(f"`{g}`") for g in group], *[choice(b).alias(f"c_{b.name}") for b in bundles])

    # Root: the most that each bundle can add, and the best choice known. Where nothing binds bundles, the best of each
    # together are a choice; a single record's values always are one.
    worth = lambda c: F.coalesce(c.getField("t"), F.lit(0.0))
    total = sum((worth(F.col(f"c_{n}")) for n in names if n in bound), F.lit(0.0))
    best = rows.groupBy(*group).agg(*[F.max(f"c_{n}").alias(f"m_{n}") for n in names], F.max(total).alias("known"))
    most = sum((worth(F.col(f"m_{n}")) for n in names if n in bound), F.lit(0.0))
    best = best.withColumn("slack", most - F.col("known"))

    # Bounding: a free bundle's value must be its best; a bound one's may fall short of its bundle's best by the slack.
    free = [n for n in names if n not in bound]
    kept: DataFrame | None = None
    if free:
        seen = rows.alias("r").join(best.alias("b"), _on(group, "r", "b"))
        kept = seen.select(*[F.col(f"r.{g}").alias(g) for g in group], *[F.when(F.col(f"c_{n}") == F.col(f"m_{n}"), F.col(f"c_{n}")).alias(f"c_{n}") for n in free])
        kept = cut(kept.where(reduce(lambda a, b: a | b, [F.col(f"c_{n}").isNotNull() for n in free])))

    def values(n: str) -> DataFrame:
        """(group, c): the bundle's live values, each once."""
        source = kept if n in free else rows
        each = source.where(F.col(f"c_{n}").isNotNull()).groupBy(*group, F.col(f"c_{n}.v").alias("v")).agg(F.max(f"c_{n}").alias("c")).select(*group, "c")
        if n in free:
            return each
        return each.alias("r").join(best.alias("b"), _on(group, "r", "b") & (F.col("r.c.t") + F.col("b.slack") + 1e-9 >= F.col(f"b.m_{n}.t"))).select("r.*")

    def pairs(n: str, x: str) -> DataFrame:
        """(group, x, v): values of two bundles that stand together in a record."""
        return rows.where(F.col(f"c_{n}").isNotNull() & F.col(f"c_{x}").isNotNull()).select(*group, F.col(f"c_{x}.v").alias("x"), F.col(f"c_{n}.v").alias("v")).distinct()

    partial = best.select(*group, F.lit(0.0).alias("sum"))
    for i, b in enumerate(bundles):
        live = values(b.name)
        none = partial.withColumn("c", F.lit(None).cast(live.schema["c"].dataType))
        if b.name in bound:
            live = cut(live)
        if not tied[b.name]:
            found = partial.alias("p").join(live.alias("q"), _on(group, "p", "q"), "left").select("p.*", "q.c")
            if b.name in bound:
                found = found.unionByName(none)
        else:
            alone = reduce(lambda a, c: a & c, [F.col(f"d_{y}").isNull() for y in tied[b.name]])
            found = none.unionByName(partial.where(alone).alias("p").join(live.alias("q"), _on(group, "p", "q")).select("p.*", "q.c"))
            for k, x in enumerate(tied[b.name]):
                # Led by the first tied bundle that is chosen; the others are looked up.
                first = reduce(lambda a, c: a & c, [F.col(f"d_{y}").isNull() for y in tied[b.name][:k]], F.col(f"d_{x}").isNotNull())
                near = partial.where(first).alias("p").join(pairs(b.name, x).alias("q"), _on(group, "p", "q") & (F.col(f"p.d_{x}.v") == F.col("q.x"))).select("p.*", "q.v")
                near = near.alias("p").join(live.alias("q"), _on(group, "p", "q") & (F.col("p.v") == F.col("q.c.v"))).select("p.*", "q.c").drop("v")
                for y in tied[b.name][k + 1 :]:
                    met = _on(group, "p", "q") & (F.col(f"p.d_{y}.v") == F.col("q.x")) & (F.col("p.c.v") == F.col("q.v"))
                    chosen = near.where(F.col(f"d_{y}").isNotNull()).alias("p").join(pairs(b.name, y).alias("q"), met, "left_semi")
                    near = near.where(F.col(f"d_{y}").isNull()).unionByName(chosen)
                found = found.unionByName(near)
        found = found.withColumn("sum", F.col("sum") + (worth(F.col("c")) if b.name in bound else F.lit(0.0))).withColumnRenamed("c", f"d_{b.name}")
        if b.name in bound:  # elsewhere there is one choice a group
            key = [F.col(f"d_{x}.v").alias(f"k_{x}") for x in open_[i]]
            found = found.groupBy(*group, *key).agg(F.max(F.struct("sum", *[f"d_{x}" for x in names[: i + 1]])).alias("s")).select(*group, "s.*")
            partial = cut(found)
        else:
            partial = found
    return partial.select(*group, *[F.col(f"d_{b.name}.v.f{i}").alias(f) for b in bundles for i, f in enumerate(b.fields)])
