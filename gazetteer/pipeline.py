"""From extract files to a workspace that answers queries, stage by stage.

Every stage reads tables and writes tables, skips what is stored already, and may be run again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import areas, catalog
from .operators import hierarchy as hi
from .operators.textindex import TextIndex
from .presets import Preset, resolve
from .scratch import discard, written
from .sources import osmpbf
from .workspace import DERIVED, Workspace


class Pipeline:
    def __init__(self, workspace: Workspace, preset: Preset | str | None = None):
        self.ws, self.spark = workspace, workspace.spark
        self.preset = preset if isinstance(preset, Preset) else resolve(preset)

    def _replaced(self, name: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """A table made from its own rows: they are written aside before the old ones go."""
        new = written(df)
        out = self.ws.put(name, new, by)
        discard(new)
        return out

    # --- extract -------------------------------------------------------------------------------------------------------

    def file_id(self, path: str) -> int:
        files, found = catalog.ensured(self.ws.table("pbf_files"), path, int(time.time()))
        self._replaced("pbf_files", files)
        return found

    def extract_chunks(self, path: str) -> int:
        """The blobs' places; how many the file has."""
        file_id = self.file_id(path)
        new = osmpbf.read(self.spark, path, "chunks").withColumn("file_id", F.lit(file_id).cast("long"))
        chunks = self._replaced("blob_chunks", catalog.chunks_upserted(self.ws.table("blob_chunks"), new))
        return catalog.chunk_count(chunks, file_id)

    def extract_header(self, path: str) -> dict:
        file_id = self.file_id(path)
        rows = osmpbf.read(self.spark, path, "header").collect()  # a file has one header
        if not rows:
            raise ValueError(f"no header block in {path}")
        found = rows[0].asDict()
        self._replaced("pbf_files", catalog.with_header(self.ws.table("pbf_files"), file_id, found, int(time.time())))
        return found

    def extract_data(self, path: str, nodes: bool = True, ways: bool = True, relations: bool = True, include: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> dict[str, int]:
        """Raw rows of the wanted kinds; an id that is stored already keeps its row."""
        file_id, counts = self.file_id(path), {}
        for entity, wanted in (("nodes", nodes), ("ways", ways), ("relations", relations)):
            if not wanted:
                counts[f"{entity[:-1]}_count"] = 0
                continue
            new = osmpbf.first_ids(osmpbf.read(self.spark, path, entity, include, ignore)).withColumn("file_id", F.lit(file_id).cast("long"))
            new = written(new)
            counts[f"{entity[:-1]}_count"] = new.count()
            self._replaced(entity, hi.first_wins(self.ws.table(entity), new.select(*self.ws.table(entity).columns), "id") if self.ws.has(entity) else new, ["id"])
            discard(new)
        self._replaced("pbf_files", catalog.with_counts(self.ws.table("pbf_files"), file_id, int(time.time()), **counts))
        return counts

    def extract_admin_levels(self, levels: list[int] | None = None) -> int:
        """Areas that are not stored yet; how many areas there are then."""
        t, stored = self.ws.table, self.ws.table("admin_levels")
        new = areas.all_areas(t("relations"), t("ways"), t("nodes"), self.preset, levels, stored if self.ws.has("admin_levels") else None)
        return self._replaced("admin_levels", areas.upserted(stored if self.ws.has("admin_levels") else None, new)).count()

    def extract_house_numbers(self) -> int:
        new = areas.house_numbers(self.ws.table("nodes"), self.ws.table("admin_levels"), self.preset)
        out = self._replaced("house_numbers", areas.merged_houses(self.ws.table("house_numbers"), new), ["admin_level_id"])
        if self.ws.has("pbf_files"):
            t = self.ws.table
            self._replaced("pbf_files", catalog.derived_counts(t("pbf_files"), t("admin_levels"), out, t("ways"), t("relations"), t("nodes")))
        return out.count()

    # --- index ---------------------------------------------------------------------------------------------------------

    def index_hierarchy(self) -> int:
        return self.ws.put("hierarchy", areas.hierarchy(self.ws.table("admin_levels"))).count()

    def index_text(self) -> int:
        """The documents: an area with a place in the hierarchy each."""
        own = self.ws.table("admin_levels").select("id", F.col("admin_level").alias("level"), "name", "post_code")
        docs = written(hi.documents(own, self.ws.table("hierarchy")))
        pairs = [(long, short) for short, long in self.preset.abbreviations]
        self.ws.save_index(TextIndex.build(docs, pairs), docs)
        n = docs.count()
        discard(docs)
        return n

    def index_coordinates(self) -> int:
        return self.ws.put("boxes", areas.boxes(self.ws.table("admin_levels"))).count()

    def index(self) -> None:
        """All three, in the order in which they need one another."""
        self.index_hierarchy()
        self.index_text()
        self.index_coordinates()

    # --- all together --------------------------------------------------------------------------------------------------

    def build(self, paths: list[str], include: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> None:
        """Everything from the files to the indexes."""
        for path in paths:
            self.extract_chunks(path)
            self.extract_header(path)
            self.extract_data(path, include=include, ignore=ignore)
        self.ws.drop(*DERIVED)
        self.extract_admin_levels()
        self.extract_house_numbers()
        self.index()

    def optimize(self, delete_raw: bool = True, compact: bool = True) -> tuple[int, int]:
        """Bytes of the workspace before and after."""
        before = self.ws.size()
        if delete_raw:
            self.ws.delete_raw()
        if compact:
            self.ws.compact()
        return before, self.ws.size()
