"""Dictionary encoding of strings or numbers: keys (code, key), sorted with null first, and codes (pos, code); -1 is no key.

Keys are ranked among the distinct ones and joined back, so rows are never ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.positions import dense, settled


def _number(keys: DataFrame) -> DataFrame:
    return dense(keys.select("key").distinct(), F.col("key").asc_nulls_first(), name="code").select("code", "key")


@dataclass
class Category:
    """A column as keys and codes."""

    keys: DataFrame
    codes: DataFrame

    @staticmethod
    def encode(frame: DataFrame, column: str = "s") -> Category:
        """The category of rows (pos, column)."""
        rows = frame.select("pos", F.col(column).alias("key"))
        return Category._of(rows, _number(rows))

    @staticmethod
    def _of(rows: DataFrame, keys: DataFrame) -> Category:
        k = keys.select(F.col("key").alias("__k"), "code")
        return Category(keys, rows.join(k, F.col("key").eqNullSafe(F.col("__k")), "left").select("pos", F.coalesce("code", F.lit(-1)).cast("long").alias("code")))

    def decode(self) -> DataFrame:
        """(pos, key); no key is null."""
        return self.codes.join(self.keys, "code", "left").select("pos", "key")

    def size(self) -> int:
        """Rows."""
        return self.codes.count()

    def keys_type(self) -> str:
        """The type of the keys."""
        return self.keys.schema["key"].dataType.simpleString()

    @staticmethod
    def merge_all(first: Category, *others: Category) -> Category:
        """Rows of all, one after another, over the sorted keys of all."""
        out = first
        for c in others:
            out = out.merge_and_remap(c)
        return out

    def keys_size(self) -> int:
        """Keys."""
        return self.keys.count()

    def value(self, key: object) -> int:
        """A key's code, -1 without one."""
        r = self.keys.filter(F.col("key").eqNullSafe(F.lit(key))).first()
        return r.code if r else -1

    def value_for_index(self, pos: int) -> int:
        """A row's code, -1 without one."""
        r = self.codes.filter(F.col("pos") == pos).first()
        return r.code if r else -1

    def indexes_for_key(self, key: object) -> DataFrame:
        """Positions of rows with the key."""
        return self.codes.join(self.keys.filter(F.col("key").eqNullSafe(F.lit(key))), "code").select("pos")

    def bounds(self, key: object) -> tuple[int, int]:
        """(code, code) of a key; else the codes that it would lie between."""
        code = self.value(key)
        if code >= 0:
            return code, code
        n = self.keys.filter(F.col("key").isNull() | (F.col("key") < F.lit(key))).count()
        return n - 1, n

    def keys_have_null(self) -> bool:
        """Whether null is a key."""
        return bool(self.keys.filter("key IS NULL").limit(1).count())

    def _remap(self, keys: DataFrame) -> Category:
        """The same rows over other keys."""
        to = keys.select(F.col("key").alias("__k"), F.col("code").alias("__new"))
        table = self.keys.join(to, F.col("key").eqNullSafe(F.col("__k")), "left").select("code", "__new")
        return Category(keys, self.codes.join(table, "code", "left").select("pos", F.coalesce("__new", F.lit(-1)).cast("long").alias("code")))

    def add_keys(self, keys: DataFrame) -> Category:
        """With more keys (key)."""
        return self._remap(_number(self.keys.select("key").unionByName(keys.select("key"))))

    def remove_keys(self, keys: DataFrame) -> Category:
        """Without keys; their rows have none."""
        k = keys.select(F.col("key").alias("__k")).distinct()
        return self._remap(_number(self.keys.join(k, F.col("key").eqNullSafe(F.col("__k")), "left_anti")))

    def set_keys(self, keys: DataFrame) -> Category:
        """With these keys alone."""
        return self._remap(_number(keys))

    def remove_unused_keys(self) -> Category:
        """Without keys that no row has."""
        return self._remap(_number(self.keys.join(self.codes.select("code").distinct(), "code", "left_semi")))

    def _rows_after(self, other: Category) -> DataFrame:
        n = self.codes.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("__n"))
        later = other.codes.join(other.keys, "code", "left").crossJoin(F.broadcast(n)).select((F.col("pos") + F.col("__n")).alias("pos"), "key", (F.col("code") >= 0).alias("has"))
        return self.codes.join(self.keys, "code", "left").select("pos", "key", (F.col("code") >= 0).alias("has")).unionByName(later)

    @staticmethod
    def _coded(rows: DataFrame, keys: DataFrame) -> Category:
        k = keys.select(F.col("key").alias("__k"), "code")
        joined = rows.join(k, F.col("has") & F.col("key").eqNullSafe(F.col("__k")), "left")
        return Category(keys, joined.select("pos", F.coalesce("code", F.lit(-1)).cast("long").alias("code")))

    def merge(self, other: Category) -> Category:
        """Rows of both; own keys keep their codes, new ones follow."""
        mine = self.keys.select(F.col("key").alias("__k"))
        new = _number(other.keys.join(mine, F.col("key").eqNullSafe(F.col("__k")), "left_anti"))
        n = self.keys.agg(F.count(F.lit(1)).alias("__n"))
        keys = settled(self.keys.unionByName(new.crossJoin(F.broadcast(n)).select((F.col("code") + F.col("__n")).alias("code"), "key")))
        return self._coded(self._rows_after(other), keys)

    def merge_and_remap(self, other: Category) -> Category:
        """Rows of both over the sorted keys of both."""
        return self._coded(self._rows_after(other), _number(self.keys.select("key").unionByName(other.keys.select("key"))))

    def add_strings(self, frame: DataFrame) -> Category:
        """With more rows (pos, s)."""
        return self.merge_and_remap(Category.encode(frame))

    def remove_strings(self, values: DataFrame) -> Category:
        """Without rows equal to any of values (s), with new positions and keys."""
        v = values.select(F.col("s").alias("__v")).distinct()
        rows = self.decode().join(v, F.col("key").eqNullSafe(F.col("__v")), "left_anti")
        return Category.encode(dense(rows.select(F.col("pos").alias("__old"), F.col("key").alias("s")), "__old").select("pos", "s"))

    def gather_strings(self, indexes: DataFrame) -> DataFrame:
        """(pos, key) of codes (pos, code); a code that isn't there raises."""
        t = indexes.join(self.keys.withColumn("__there", F.lit(True)), "code", "left")
        bad = F.raise_error(F.lit("code out of range"))
        return t.select("pos", F.when(F.col("__there").isNull(), bad.cast(self.keys.schema["key"].dataType)).otherwise(F.col("key")).alias("key"))

    def gather(self, indexes: DataFrame) -> Category:
        """The codes (pos, code) as rows over the same keys."""
        return Category(self.keys, indexes.select("pos", "code"))

    def gather_and_remap(self, indexes: DataFrame) -> Category:
        """The same over the keys that are used."""
        return self.gather(indexes).remove_unused_keys()

    def gather_values(self, indexes: DataFrame) -> DataFrame:
        """(pos, key) of rows (pos, index)."""
        return indexes.join(self.decode().withColumnRenamed("pos", "index"), "index").select("pos", "key")


def predicate_positions(codes: DataFrame, where: Column) -> DataFrame:
    """Positions of the codes for which a condition holds."""
    return codes.filter(where).select("pos")
