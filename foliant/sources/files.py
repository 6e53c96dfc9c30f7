"""Documents as files: a data source that reads the parts of packages from a folder, and a sink that commits many files at once.

`spark.read.format("document_parts").load(folder)` has a row for each part of each package. Filters on document, part and kind reach the reader: files
that no filter admits aren't opened, and of a package only the admitted parts are inflated. `df.write.format("document_files")` writes rows (file, bytes)
in two phases: each task writes into a folder of its own, with lists of what it wrote, and one manifest, written last, names the tasks' folders that
count and the number of their lists. Until it is there, readers of the folder see nothing of the write; a failed write leaves no file that is read.
The manifest's size is one entry a task. What was written is read again by its lists, one or more a task, so the driver lists no files then.

Files are reached through Arrow's file systems: local paths, HDFS and object stores by their addresses.
"""

from __future__ import annotations

import json
import posixpath
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PARTS = "document string, part string, kind string, size long, bytes binary, error string"
FILES = "file string, bytes binary"
#: Bytes of the files that one partition takes up, about; bytes of an inflated part beyond which it is an error row.
GROUP_BYTES, PART_BYTES = 64 << 20, 256 << 20
#: Files that one list of a task, and one partition of a read, names at most: small files cost more than their bytes tell.
GROUP_FILES = 10_000
_KINDS = (("section", r"^Contents/section[0-9]+\.xml$"), ("header", r"^Contents/header\.xml$"), ("binary", r"^BinData/"), ("meta", r"^(mimetype$|META-INF/|version\.xml$|settings\.xml$)"))
_MANIFEST = re.compile(r"^commit-[0-9a-f]+\.json$")


def part_kind(name: str) -> str:
    return next((k for k, pattern in _KINDS if re.match(pattern, name)), "other")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _committed(system, root: str) -> dict[str, int | None] | None:
    """The folders of tasks that count, with the number of their lists; None where nothing was ever written by the sink. Looks at top folders only."""
    from pyarrow import fs

    top = [x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    if not any(n == "_committed" or n.startswith("_task-") for n in top):
        return None
    counted: dict[str, int | None] = {}
    for x in system.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True)):
        if _MANIFEST.match(x.base_name):
            with system.open_input_stream(x.path) as f:
                held = json.loads(f.read())
            counted.update(held if isinstance(held, dict) else dict.fromkeys(held))
    return counted


def _found(system, root: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of the files below a folder, without hidden ones."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [(posixpath.relpath(x.path, root), x.path, x.size) for x in found if x.type == fs.FileType.File]
    return [x for x in names if not any(s.startswith((".", "_")) for s in x[0].split("/"))]


def listed(path: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of the files of a folder, without hidden ones. Where the folder has manifests, what no manifest names isn't there."""
    system, root = _system(path)
    counted = _committed(system, root)
    return sorted(_found(system, root) if counted is None else [x for folder in counted for x in _found(system, f"{root}/{folder}")])


def _admits(filters: list[Filter], values: dict[str, str]) -> bool:
    """Whether all filters on the columns that are known admit the values."""
    for f in filters:
        name = f.attribute[0]
        if name in values and values[name] not in (f.value if isinstance(f, In) else (f.value,)):
            return False
    return True


class _Group(InputPartition):
    """Files, or a task's folder that the sink wrote with the number of one of its lists (None if it has none)."""

    def __init__(self, files: list[tuple[str, str]], folder: str | None = None, number: int | None = None) -> None:
        super().__init__(len(files))
        self.files, self.folder, self.number = files, folder, number


class _PartsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.group = int(options.get("groupbytes", GROUP_BYTES))
        self.limit = int(options.get("partbytes", PART_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("document", "part", "kind"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        counted = _committed(*_system(self.path))
        if counted is not None:
            return [_Group([], folder, i) for folder, n in sorted(counted.items()) for i in ([None] if n is None else range(n))] or [_Group([])]
        groups: list[list[tuple[str, str]]] = [[]]
        held = 0
        for name, path, size in listed(self.path):
            if not _admits(self.filters, {"document": name}):
                continue
            if groups[-1] and (held + size > self.group or len(groups[-1]) >= GROUP_FILES):
                groups.append([])
                held = 0
            groups[-1].append((name, path))
            held += size
        return [_Group(g) for g in groups if g] or [_Group([])]

    def files_of(self, system, root: str, partition: _Group) -> Iterator[tuple[str, str]]:
        """(name, path) of the files of a partition that the filters admit."""
        if partition.folder is None:
            yield from partition.files
            return
        base = f"{root}/{partition.folder}"
        if partition.number is None:
            names = [n for n, *_ in _found(system, base)]
        else:
            with system.open_input_stream(_list_path(base, partition.number)) as f:
                names = json.loads(f.read())
        yield from ((n, f"{base}/{n}") for n in names if _admits(self.filters, {"document": n}))

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, root = _system(self.path)
        for name, path in self.files_of(system, root, partition):
            try:
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        kind = part_kind(info.filename)
                        if info.is_dir() or not _admits(self.filters, {"document": name, "part": info.filename, "kind": kind}):
                            continue
                        if info.file_size > self.limit:
                            yield name, info.filename, kind, info.file_size, None, f"larger than {self.limit} bytes"
                            continue
                        try:
                            with z.open(info) as part:
                                data = part.read(self.limit + 1)
                            yield (name, info.filename, kind, len(data), data, None) if len(data) <= self.limit else (name, info.filename, kind, None, None, f"larger than {self.limit} bytes")
                        except Exception as e:  # a damaged part is a row, not a failed job
                            yield name, info.filename, kind, None, None, f"{type(e).__name__}: {e}"
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                if all(f.attribute == ("document",) for f in self.filters):
                    yield name, None, None, None, None, f"{type(e).__name__}: {e}"


class DocumentParts(DataSource):
    """The parts of the packages in a folder. A file that isn't a package, and a part that is damaged or too large, is a row with an error; a file's
    error row has no part and no kind, so no filter on these admits it."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> _PartsReader:
        return _PartsReader(dict(self.options))


def _list_path(folder: str, number: int) -> str:
    return f"{folder}/_lists/{number}.json"


class _Written(WriterCommitMessage):
    def __init__(self, folder: str, lists: int) -> None:
        self.folder, self.lists = folder, lists


class _FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        # Tasks make folders inside this one only, so that one that outlives its write finds no place any more.
        system, root = _system(self.path)
        system.create_dir(f"{root}/_task-{self.job}", recursive=True)

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        system, root = _system(self.path)
        task = TaskContext.get()
        folder = f"_task-{self.job}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        base = f"{root}/{folder}"
        seen: set[str] = set()
        made: set[str] = set()
        names: list[str] = []
        lists = held = 0

        def within(place: str) -> str:
            """Makes the missing folders of a file, one by one: none outside the job's."""
            steps = place.split("/")[:-1]
            for i in range(len(steps) + 1):
                if (own := "/".join([base, *steps[:i]])) not in made:
                    system.create_dir(own, recursive=False)
                    made.add(own)
            return f"{base}/{place}"

        def put_list() -> None:
            nonlocal lists, held
            within("_lists/x")
            with system.open_output_stream(_list_path(base, lists)) as out:
                out.write(json.dumps(names).encode())
            lists, held = lists + 1, 0
            names.clear()

        try:
            for row in rows:
                name, data = safe_path(row["file"]), bytes(row["bytes"] or b"")
                if name in seen:
                    raise ValueError(f"two rows for the file {name}")
                seen.add(name)
                with system.open_output_stream(within(name)) as out:
                    out.write(data)
                if names and (held + len(data) > GROUP_BYTES or len(names) >= GROUP_FILES):
                    put_list()
                names.append(name)
                held += len(data)
            if names:
                put_list()
        except BaseException:
            system.delete_dir_contents(base, missing_dir_ok=True)
            raise
        return _Written(folder, lists)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _system(self.path)
        done = {m.folder: m.lists for m in messages if m is not None and m.lists}
        system.create_dir(f"{root}/_committed", recursive=True)
        earlier = [x.path for x in self._manifests(system, root)] if self.overwrite else []
        # A manifest counts once it has its name.
        draft = f"{root}/_committed/.{self.job}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(done).encode())
        system.move(draft, f"{root}/_committed/commit-{self.job}.json")
        for path in earlier:
            system.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        """Removes what tasks of this write have left, those of failed attempts too. What it can't remove no manifest names."""
        system, root = _system(self.path)
        for again in range(10):
            try:
                system.delete_dir(f"{root}/_task-{self.job}")
                return
            except FileNotFoundError:
                return
            except OSError:  # a task that is being ended still writes there
                if again == 9:
                    raise
                time.sleep(0.2)

    def _manifests(self, system, root: str) -> list:
        from pyarrow import fs

        return [x for x in system.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True)) if _MANIFEST.match(x.base_name)]


class DocumentFiles(DataSource):
    """Rows (file, bytes) as files, committed together; append adds to what is there, overwrite replaces what counted before."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> _FilesWriter:
        return _FilesWriter(dict(self.options), overwrite)

    def reader(self, schema) -> _FilesReader:
        return _FilesReader(dict(self.options))


class _FilesReader(_PartsReader):
    """Whole files by name."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                self.filters.append(type(f)(("document",), f.value))
            else:
                yield f

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, root = _system(self.path)
        for name, path in self.files_of(system, root, partition):
            with system.open_input_stream(path) as f:
                yield name, f.read()


def safe_path(name: str | None) -> str:
    """A relative path without steps that are empty or lead out of the folder, or that readers would pass over."""
    steps = [s for s in (name or "").replace("\\", "/").split("/") if s not in ("", ".")]
    if not steps or any(s == ".." or s.startswith((".", "_")) or "\0" in s for s in steps):
        raise ValueError(f"not a file name: {name!r}")
    return "/".join(steps)


def safe_name(x: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, that starts with a letter or digit; `file` where nothing is left."""
    last = F.regexp_extract(F.coalesce(x, F.lit("")), r"([^/\\]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}._-]+", "-"), r"^[._-]+", "")
    return F.when(plain == "", "file").otherwise(plain)


def companions(texts: DataFrame, assets: DataFrame, extension: str = "md") -> DataFrame:
    """(file, bytes) of texts(document, text), one for each document, and assets(document, name, bytes): `document.md` and `document.assets/name`.

    Names are made safe, and where several of a document then agree, whatever their case, the later ones in order of name and content get a number
    before their extension. Assets without a text stay."""
    base = safe_name(F.col("document"))
    main = texts.select(F.concat(base, F.lit(f".{extension}")).alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    named = assets.select("document", safe_name(F.col("name")).alias("safe"), "name", "bytes")
    nth = F.row_number().over(Window.partitionBy("document", F.lower("safe")).orderBy(F.col("name").asc_nulls_first(), F.sha2("bytes", 256)))
    stem, end = F.regexp_extract("safe", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("safe", r"^(.*?)(\.[^.]*)?$", 2)
    # "~" stands in no safe name, so numbered names can't meet others.
    own = named.withColumn("nth", nth).withColumn("file", F.when(F.col("nth") == 1, F.col("safe")).otherwise(F.concat(stem, F.lit("~"), F.col("nth").cast("string"), end)))
    return main.unionByName(own.select(F.concat(base, F.lit(".assets/"), "file").alias("file"), "bytes"))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session and lets filters reach them."""
    spark.dataSource.register(DocumentParts)
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, or, with a local master only, below a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return f"{where.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"
