"""A data source that lists the files below a folder, a sub-folder to a partition; contents are never opened."""

import posixpath

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITIONS = 64


class Folders(InputPartition):
    """A folder to walk through, and how deep: with its sub-folders or without."""

    def __init__(self, folder, recursive):
        self.folder, self.recursive = folder, recursive


def _selected(file_system, folder, recursive):
    from pyarrow.fs import FileSelector

    return file_system.get_file_info(FileSelector(folder, recursive=recursive))


class ListingReader(DataSourceReader):
    """Walks a local folder or any store that Arrow knows by its address."""

    def __init__(self, root):
        from pyarrow.fs import FileSystem

        self.root = root.rstrip("/")
        self.top = FileSystem.from_uri(self._address())[1].rstrip("/")

    def _address(self):
        scheme, _, rest = self.root.partition(":")
        return self.root if rest.startswith("//") else f"{scheme}://{rest}"

    def _files(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self._address())[0]

    def partitions(self):
        """Folders are opened level by level until there are enough to share out."""
        from pyarrow.fs import FileType

        files = self._files()
        if files.get_file_info(self.top).type != FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")
        done, level = [], [self.top]
        while level and len(done) + len(level) < PARTITIONS:
            below = [info.path for folder in level for info in _selected(files, folder, False) if info.type == FileType.Directory]
            done += [Folders(folder, False) for folder in level]
            level = below
        return done + [Folders(folder, True) for folder in level]

    def read(self, partition):
        from pyarrow.fs import FileType

        for info in _selected(self._files(), partition.folder, partition.recursive):
            if info.type == FileType.File:
                yield (f"{self.root}/{posixpath.relpath(info.path, self.top)}", info.size, info.mtime)


class Listing(DataSource):
    """``spark.read.format("listing").load(root)``: path, length and time of change of every file, empty ones too."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "path string, length long, mtime timestamp"

    def reader(self, schema):
        return ListingReader(self.options["path"])
