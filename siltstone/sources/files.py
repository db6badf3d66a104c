"""Small files and folders on whatever file system a path names, by Hadoop's API: local in tests, shared on a cluster."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="siltstone-shared-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
        self.array = spark.sparkContext._gateway.new_array  # noqa: SLF001

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        """The text of a file; None where there is none."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a file beside and renames it over the old one, so that readers see one or the other whole."""
        p, fs = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        ways = self.array(rename, 1)
        ways[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(new), fs.makeQualified(p), ways)

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change) of what a folder holds, in order; empty where there is none."""
        p, fs = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else []


def version_of(df: DataFrame) -> str | None:
    """What tells this content of files from any other: the plan, and names, sizes and times of the folders read; None without files."""
    read = sorted({f.rpartition("/")[0] for f in df.inputFiles()})
    if not read:
        return None
    files = Files(df.sparkSession)
    own = {f.rpartition("/")[2] for f in df.inputFiles()}
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())  # noqa: SLF001
    state = [(folder, [x for x in files.names(folder) if x[0] in own]) for folder in read]
    return hashlib.blake2b(repr((df.columns, plan, state)).encode(), digest_size=12).hexdigest()


def size_of(df: DataFrame) -> int:
    """Bytes of the files that are read; 0 without files."""
    files, read = Files(df.sparkSession), df.inputFiles()
    own = {f.rpartition("/")[2] for f in read}
    return sum(n for folder in {f.rpartition("/")[0] for f in read} for name, n, _ in files.names(folder) if name in own)
