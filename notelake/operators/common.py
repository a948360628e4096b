"""Shared pieces: size-checked broadcast, listing order, running maxima."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .checkpoints import checkpoint

# So many rows, with so many bytes of text, stay far below what one executor can hold.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A key filter has a bit for every hash modulo this, 8 MB however many keys there are.
KEY_BITS = 1 << 26
_BUCKET = 32768  # bits of one bitmap_construct_agg value
# Runs that the rows of a hot key are cut into.
RANK_BLOCKS = 256
_CUTS = 16


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Counts no further than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """At most so many rows and bytes of text; counts no further than ``rows + 1``."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    length = sum(texts, F.lit(0)).cast("bigint")
    n, held = df.select(length.alias("n")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n <= rows and held <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it was counted to be small; else leave the
    join to shuffle.  Meant for narrow rows (keys, registry entries)."""
    return F.broadcast(df) if is_small(df, rows) else df


@dataclass(frozen=True)
class KeyFilter:
    """Which of ``columns`` values may be among some keys: a bitmap of their hashes, of fixed size.

    It keeps what no key touches out of a shuffle.  A set bit may be due to another key, so an exact join
    has to follow; a full bitmap holds nothing back and loses nothing.
    """

    bits: DataFrame
    columns: tuple[str, ...]

    @staticmethod
    def of(keys: DataFrame, *columns: str) -> "KeyFilter":
        at = F.pmod(F.xxhash64(*columns), F.lit(KEY_BITS))
        bits = (
            keys.select(at.alias("at"))
            .groupBy(F.floor(F.col("at") / _BUCKET).alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("__bits"))
        )
        return KeyFilter(checkpoint(bits), columns)  # 2,048 rows of 4 KB at most

    def _marked(self, df: DataFrame) -> tuple[DataFrame, Column]:
        at = F.pmod(F.xxhash64(*self.columns), F.lit(KEY_BITS))
        bit = at % _BUCKET
        byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        marked = df.withColumn("__bucket", F.floor(at / _BUCKET)).join(F.broadcast(self.bits), "__bucket", "left")
        return marked, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))

    def possible(self, df: DataFrame) -> DataFrame:
        """Rows that may match a key."""
        marked, hit = self._marked(df)
        return marked.filter(hit).drop("__bucket", "__bits")

    def others(self, df: DataFrame) -> DataFrame:
        """Rows that match no key."""
        marked, hit = self._marked(df)
        return marked.filter(~hit).drop("__bucket", "__bits")


def listing_key(c: Column | str, collation: str | None = "UNICODE") -> Column:
    """Sort key of names: locale collation, or byte order with ``None``."""
    c = F.col(c) if isinstance(c, str) else c
    return c if collation is None else F.collate(c, collation)


def numbered(df: DataFrame, out: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of its partitions and rows.

    One pass counts the partitions, one row each, and a second adds their offsets.
    """
    placed = checkpoint(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("__part"))
        .count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__at", "__part", "__offset")
    )


def rank_blocks(df: DataFrame, keys: list[str], order: str, out: str, blocks: int = RANK_BLOCKS) -> DataFrame:
    """Number runs of about equal size of each key's rows in ``order``.

    The cuts are approximate quantiles, at most ``blocks`` of them per key, so it does not matter
    how the numbers of ``order`` are spread.
    """
    fractions = [i / blocks for i in range(1, blocks)] or [0.5]
    # Measured once, then counted, broadcast and used from the copy.
    cuts = checkpoint(df.groupBy(*keys).agg(F.percentile_approx(order, fractions, 100 * blocks).alias("__cuts")))
    # The cuts ascend: whole sixteens below the value first, then the rest within the sixteen that it falls into.
    lasts = cuts.withColumn("__lasts", F.filter("__cuts", lambda c, i: (i + 1) % _CUTS == 0))

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda c: c < F.col(order)))

    whole = below(F.col("__lasts")) * _CUTS
    cut = (whole + below(F.slice("__cuts", whole + 1, F.lit(_CUTS)))).cast("bigint")
    return df.join(broadcast_if_small(lasts), keys).withColumn(out, cut).drop("__cuts", "__lasts")


def block_carries(rows: DataFrame, keys: list[str], block: str, value: str, out: str) -> DataFrame:
    """For each block the maximum of ``value`` over its key's earlier blocks: one row per block, written once."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, block).agg(F.max(value).alias("__last"))
    return broadcast_if_small(checkpoint(last.select(*keys, block, F.max("__last").over(before).alias(out))))


def inside_block(keys: list[str], block: str, order: str, *, inclusive: bool):
    """The window from a block's first row to the current one, or to the one before it."""
    end = 0 if inclusive else -1
    return Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def running_max(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    *,
    inclusive: bool,
    blocks: int = RANK_BLOCKS,
) -> DataFrame:
    """Running maximum of ``value`` per key in ``order``, safe for hot keys.

    A plain window would put all rows of a key into one task.  Here the rows of a key are
    cut into ``blocks`` runs by rank; a second window runs over one summary row per
    block, and its carry is joined back to the rows of the block.
    """
    block, carry, held = f"__{out}_block", f"__{out}_carry", f"__{out}_value"
    rows = rank_blocks(df, keys, order, block, blocks).withColumn(held, value)
    carries = block_carries(rows, keys, block, held, carry)
    return (
        rows.withColumn(out, F.max(held).over(inside_block(keys, block, order, inclusive=inclusive)))
        .join(carries, [*keys, block], "left")
        .withColumn(out, F.greatest(out, carry))
        .drop(block, carry, held)
    )
