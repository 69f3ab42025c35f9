"""Workbooks on disk: a frozen spec beside a stored table. Without a spec a file can be seen but not asked."""

from __future__ import annotations

import shutil
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession
from yaml import YAMLError

from tracegrid.operators import ingest
from tracegrid.plans.ask import Workbook
from tracegrid.plans.catalog import Catalog, build_catalog
from tracegrid.plans.gates import Memory
from tracegrid.plans.spec import Spec, confirmed
from tracegrid.sources.cells import SUFFIXES, read_cells

CATALOGS = 8


class Registry:
    """Specs, files and stores under one folder, and a memory for each session and workbook.

    The folder must be one that the driver and all executors see under the same path.
    """

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, Path(folder)
        for name in ("files", "specs", "stores"):
            (self.folder / name).mkdir(parents=True, exist_ok=True)
        self.memories: dict[tuple[str, str], Memory] = {}
        self._catalog = lru_cache(CATALOGS)(self._build_catalog)

    def specs(self) -> dict[str, Spec]:
        """Confirmed workbooks by table name; a spec that cannot be read is passed over."""
        out = {}
        for path in sorted((self.folder / "specs").glob("*.yaml")):
            try:
                spec = Spec.load(path)
            except (ValueError, TypeError, KeyError, AttributeError, YAMLError):
                continue
            out[spec.table] = spec
        return out

    def resolve(self, table: str | None = None) -> Spec:
        """The named workbook, or the only one there is."""
        known = self.specs()
        if table is None and len(known) == 1:
            return next(iter(known.values()))
        if table not in known:
            raise KeyError(f"no workbook {table!r}; there are {', '.join(known) or 'none'}")
        return known[table]

    def files(self) -> list[str]:
        return sorted(p.name for p in (self.folder / "files").iterdir() if p.suffix.lower() in SUFFIXES)

    def upload(self, name: str, data: bytes) -> Path:
        """Keep a file; only bare names with a known suffix are taken."""
        if Path(name).name != name or Path(name).suffix.lower() not in SUFFIXES:
            raise ValueError(f"{name!r} is no file that can be read")
        path = self.folder / "files" / name
        path.write_bytes(data)
        return path

    def confirm(self, spec: Spec) -> dict[str, int]:
        """Ingest first, and only then keep the spec, so that no spec stands without its table."""
        spec = confirmed(spec)
        cells = read_cells(self.spark, str(self.folder / "files" / spec.file))
        counts = ingest.save(ingest.ingest(cells, spec), str(self.folder / "stores" / spec.table))
        spec.save(self.folder / "specs" / f"{spec.table}.yaml")
        return counts

    def _build_catalog(self, table: str, stamp: float) -> Catalog:
        spec = self.resolve(table)
        rows, _, notes = ingest.load(self.spark, str(self.folder / "stores" / table))
        said = tuple(r["text"] for r in notes.orderBy("sheet", "a1").collect())  # as many as the spec's note rows
        return build_catalog(rows, spec.table, spec.measure, layout=spec.layout, defaults=spec.defaults, aliases=spec.aliases, units={spec.measure: spec.unit} if spec.unit else None, absent=tuple(spec.absent), notes=said, entity=spec.entity, period=spec.period)

    def workbook(self, table: str | None = None) -> Workbook:
        """The workbook with its catalog, which is built anew when the store has changed."""
        spec = self.resolve(table)
        rows, receipts, _ = ingest.load(self.spark, str(self.folder / "stores" / spec.table))
        stamp = (self.folder / "specs" / f"{spec.table}.yaml").stat().st_mtime
        return Workbook(rows, receipts, self._catalog(spec.table, stamp))

    def memory(self, session: str, table: str) -> Memory:
        return self.memories.setdefault((session, table), Memory())

    def clear_session(self, session: str) -> None:
        self.memories = {k: m for k, m in self.memories.items() if k[0] != session}

    def delete(self, table: str) -> None:
        """Forget a workbook: its spec, its store, its file and what sessions remember of it."""
        spec = self.resolve(table)
        (self.folder / "specs" / f"{table}.yaml").unlink()
        shutil.rmtree(self.folder / "stores" / table, ignore_errors=True)
        (self.folder / "files" / spec.file).unlink(missing_ok=True)
        self.memories = {k: m for k, m in self.memories.items() if k[1] != table}
