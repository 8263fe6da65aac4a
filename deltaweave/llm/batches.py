"""Facts that rows of a table ask for by hash, without joining or moving the rows.

The rows of a file-backed table are numbered by their place in the files, in
batches of BLOCK. Each batch asks once for every distinct hash that its rows
hold; what comes back is written by batch, and the pass that needs it reads
the answers of the batch that it is in. Only hashes travel, a hash that all
rows hold travels once a batch, and memory is bounded by a batch's answers.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import open_shared, shared_dir, stored

#: Rows of a batch; batches whose answers share a folder, once there are more folders than FOLDERS.
BLOCK, FOLDER, FOLDERS = 1 << 14, 64, 1024


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows, whose columns have positional names, with _batch bigint last; the same whenever it is read.

    Rows that don't come from Parquet files as they are, are stored first.
    """
    try:
        place = F.floor(F.col("_metadata.row_index") / block)
        return rows.select("*", F.xxhash64("_metadata.file_path", place).alias("_batch"))
    except AnalysisException:
        return numbered(stored(rows), block)


class Answers:
    """Rows (batch, hash words, owner) in files by batch; a worker holds those of the batch that it is in."""

    def __init__(self, path: str, folders: int, columns: list[str]):
        self.path, self.folders, self.columns = path, folders, columns
        self.batch, self.held = None, []

    @classmethod
    def write(cls, rows: DataFrame, columns: list[str], batches: int) -> Answers:
        """rows has batch bigint and the columns; batches: about how many there are."""
        path = shared_dir(rows.sparkSession)
        folders = max(1, batches // FOLDER, min(batches, FOLDERS))
        placed = rows.select(F.pmod("batch", F.lit(folders)).alias("folder"), "batch", *columns)
        placed.repartition("folder").sortWithinPartitions("folder", "batch", *columns).write.partitionBy("folder").option("parquet.block.size", 8 << 20).parquet(path)
        return cls(path, folders, columns)

    def of(self, batch: int) -> list[np.ndarray]:
        """The columns of the batch's answers, sorted by the first."""
        if batch != self.batch:
            import pyarrow.dataset as ds
            from pyarrow import fs

            files, at = open_shared(f"{self.path}/folder={batch % self.folders}")
            if files.get_file_info(at).type == fs.FileType.NotFound:
                got = [np.zeros(0, np.int64) for _ in self.columns]
            else:
                t = ds.dataset(at, filesystem=files, format="parquet").to_table(columns=self.columns, filter=ds.field("batch") == batch)
                got = [c.to_numpy() for c in t.columns]
            order = np.argsort(got[0], kind="stable")
            self.batch, self.held = batch, [x[order] for x in got]
        return self.held


def runs(batch: np.ndarray):
    """(begin, end, batch) of the runs of equal batches among rows in order."""
    if len(batch):
        cut = np.append(np.flatnonzero(np.append(True, batch[1:] != batch[:-1])), len(batch))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield a, b, int(batch[a])
