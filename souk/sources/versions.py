"""Tables kept in versions: files are only added, and a manifest says which of them make up the table.

    <path>/data/commit=<id>/[<by>=<value>/]part-*.parquet    one folder per write, never changed
    <path>/versions/<number>.json                            manifests

A write puts its files into a folder of its own and then adds the manifest of the next number, in one step that fails if
another writer had that number first. Until then readers see the version before, so a write that dies leaves
nothing but a folder no manifest names. The last two versions can be read; a write removes what only older ones name.

A manifest lists the parts of the table, a part being the rows of one write with one value of ``by`` (a day or a plain word), with
their number and the least and greatest value of some columns: what lies outside is not read, and such a value needs no scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souk.session import COMPRESSION
from souk.sources import files

COMMIT = "commit"
#: Versions that stay readable.
KEPT = 2
#: Folder of the rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentWrite(Exception):
    """Another writer changed the table since it was read."""


@dataclass(frozen=True)
class Part:
    commit: str
    value: str | None
    of: int
    rows: int
    low: dict[str, str | None] = field(compare=False, hash=False)
    high: dict[str, str | None] = field(compare=False, hash=False)

    def may_hold(self, column: str, low: str | None, high: str | None) -> bool:
        """Whether some value of the column could lie between the two."""
        if low is None or column not in self.low:
            return column not in self.low
        return self.low[column] is not None and self.low[column] <= high and low <= self.high[column]


@dataclass(frozen=True)
class Manifest:
    version: int
    fields: StructType
    parts: tuple[Part, ...]

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "fields": self.fields.jsonValue(), "parts": [asdict(p) for p in self.parts]})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        read = json.loads(text)
        return cls(read["version"], StructType.fromJson(read["fields"]), tuple(Part(**p) for p in read["parts"]))

    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    def span(self, column: str) -> tuple | None:
        """Least and greatest value of a column, None if they are not known or there are none."""
        if any(column not in p.high for p in self.parts):
            return None
        lows = [p.low[column] for p in self.parts if p.low[column] is not None]
        highs = [p.high[column] for p in self.parts if p.high[column] is not None]
        if not highs:
            return None
        kind = self.fields[column].dataType.typeName()
        read = {"date": date.fromisoformat, "timestamp_ntz": datetime.fromisoformat}.get(kind, str)
        return read(min(lows)), read(max(highs))


class VersionedTable:
    """One table at ``path``. ``by`` names the column whose values make folders; for ``zones`` see ``Part``."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, zones: Collection[str] = ()):
        self.spark, self.path, self.by, self.zones = spark, path.rstrip("/"), by, tuple(dict.fromkeys(zones))

    # ---- reading ----

    def _versions(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, by default of the newest; None if the table was never written."""
        if version is None:
            found = self._versions()
            if not found:
                return None
            version = int(found[-1].removesuffix(".json"))
        text = files.read_text(self.spark, f"{self.path}/versions/{version:08d}.json")
        return Manifest.from_json(text) if text else None

    def _folder(self, commit: str, value: str | None = None) -> str:
        inside = f"/{self.by}={value}" if value is not None else ""
        return f"{self.path}/data/{COMMIT}={commit}{inside}"

    def read(self, manifest: Manifest | None = None, parts: Collection[Part] | None = None, with_commit: bool = False) -> DataFrame:
        """The table, or some of its parts. Columns that later writes added are NULL in older rows. Starts no job."""
        manifest = manifest or self.manifest()
        chosen = manifest.parts if parts is None else parts
        fields = StructType([*manifest.fields.fields, StructField(COMMIT, StringType())])
        names = fields.names if with_commit else manifest.fields.names
        if not chosen:
            return self.spark.createDataFrame([], fields).select(*names)
        live: dict[str, list[Part]] = {}
        for p in chosen:
            live.setdefault(p.commit, []).append(p)
        folders = []
        for commit, some in live.items():
            whole = len(some) == some[0].of
            folders += [self._folder(commit)] if whole else [self._folder(commit, p.value) for p in some]
        reader = self.spark.read.schema(fields).option("basePath", f"{self.path}/data")
        return reader.parquet(*folders).select(*names)

    # ---- writing ----

    def commit(
        self,
        df: DataFrame,
        instead_of: Iterable[Part] | None = None,
        base: Manifest | None = None,
        derived: Mapping[str, Column] | None = None,
    ) -> Manifest:
        """Write rows as the next version: instead of some parts of the version ``base``, by default of everything.

        A partitioned write is rebalanced on its partition column first: adaptive execution then merges small parts into one
        file each and splits a large one over many tasks. ``derived`` columns are added to the rows after that, so they are not
        shuffled.
        """
        now = self.manifest()
        current = now.version if now else 0
        if instead_of is not None and (base.version if base else 0) != current:
            raise ConcurrentWrite(f"{self.path}: version {current} is not the one that was read")
        fresh = uuid.uuid4().hex
        if self.by:
            df = df.hint("rebalance", self.by).withColumns(dict(derived or {}))
            df.write.option("compression", COMPRESSION).partitionBy(self.by).parquet(self._folder(fresh))
        else:
            df = df.withColumns(dict(derived or {}))
            df.write.option("compression", COMPRESSION).parquet(self._folder(fresh))
        # Only the columns asked for are read back, and of a table without any nothing but file footers.
        zones = [z for z in self.zones if z in df.columns]
        spans = [f(F.col(z)).cast("string").alias(f"{f.__name__}_{at}") for at, z in enumerate(zones) for f in (F.min, F.max)]
        written = self.spark.read.schema(df.schema).parquet(self._folder(fresh))
        measures = [F.count(F.lit(1)).alias("n"), *spans]
        if self.by:
            seen = written.groupBy(F.col(self.by).cast("string").alias("value")).agg(*measures).collect()
        else:
            seen = written.agg(*measures, F.lit(None).cast("string").alias("value")).collect()
        parts = [
            Part(
                fresh,
                NO_VALUE if self.by and r["value"] is None else r["value"],
                len(seen),
                r["n"],
                {z: r[f"min_{at}"] for at, z in enumerate(zones)},
                {z: r[f"max_{at}"] for at, z in enumerate(zones)},
            )
            for r in seen
        ]
        if instead_of is None:
            fields, kept = df.schema, []
        else:
            gone, known = set(instead_of), base.fields.names if base else []
            kept = [p for p in base.parts if p not in gone] if base else []
            fields = StructType([*(base.fields.fields if base else []), *[f for f in df.schema.fields if f.name not in known]])
        manifest = Manifest(current + 1, fields, (*kept, *parts))
        self._publish(manifest)
        self._expire(manifest)
        return manifest

    def _publish(self, manifest: Manifest) -> None:
        path = f"{self.path}/versions/{manifest.version:08d}.json"
        try:
            files.create_text(self.spark, path, manifest.to_json())
        except Exception as e:
            if files.read_text(self.spark, path) is None:
                raise
            raise ConcurrentWrite(f"{self.path}: version {manifest.version} was written meanwhile") from e

    def _expire(self, manifest: Manifest) -> None:
        """Remove old manifests, and what they name and later ones don't."""
        old = [n for n in self._versions() if int(n.removesuffix(".json")) <= manifest.version - KEPT]
        if not old:
            return
        needed = {p.commit for v in range(manifest.version - KEPT + 1, manifest.version) for p in self.manifest(v).parts}
        needed |= {p.commit for p in manifest.parts}
        for name in old:
            expired = self.manifest(int(name.removesuffix(".json")))
            for commit in {p.commit for p in expired.parts} - needed:
                files.remove(self.spark, self._folder(commit))
            files.remove(self.spark, f"{self.path}/versions/{name}")

    def remove_strays(self) -> list[str]:
        """Remove folders of writes that died, and return their names. Only while nobody writes."""
        named = {p.commit for v in self._versions() for p in self.manifest(int(v.removesuffix(".json"))).parts}
        strays = [n for n in files.names(self.spark, f"{self.path}/data") if n.removeprefix(f"{COMMIT}=") not in named]
        for n in strays:
            files.remove(self.spark, f"{self.path}/data/{n}")
        return strays
