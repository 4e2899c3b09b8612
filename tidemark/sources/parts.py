"""Single files that tasks write in pieces.

A file whose format wants one file with an index is written by many tasks: each puts its blocks into a part file beside the target
and tells the commit where they are, a few bytes a block. The commit works out the index and streams the parts into the target in
pieces of bounded size; nothing but index entries is held. A lost or repeated task leaves a part that no message
names; the folder of parts goes at the end, and the target appears by one move."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

PIECE = 1 << 23


def filesystem(path: str):
    """(filesystem, path in it) of a plain path or a URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Parts:
    """The part files of one target; travels to the tasks by its two paths."""

    def __init__(self, target: str):
        self.target, self.folder = target, f"{target}.parts-{uuid.uuid4().hex}"

    def open(self) -> tuple[str, object]:
        """A new part's path and a stream to write it."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        fs, inside = filesystem(path)
        fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        return path, fs.open_output_stream(inside, compression=None)

    def assemble(self, pieces: Iterable[bytes | str]) -> None:
        """Write the target from bytes and the paths of parts, then let the parts go."""
        fs, target = filesystem(self.target)
        whole = f"{self.folder}/whole"
        fs.create_dir(filesystem(self.folder)[1], recursive=True)
        with fs.open_output_stream(filesystem(whole)[1], compression=None) as out:
            for piece in pieces:
                for part in [piece] if isinstance(piece, bytes) else stream(piece):
                    out.write(part)
        fs.move(filesystem(whole)[1], target)
        self.discard()

    def remove(self) -> None:
        """Take away a target that is there."""
        fs, target = filesystem(self.target)
        if fs.get_file_info(target).type.name != "NotFound":
            fs.delete_file(target)

    def discard(self) -> None:
        fs, folder = filesystem(self.folder)
        from pyarrow.fs import FileType

        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


def stream(path: str) -> Iterator[bytes]:
    fs, inside = filesystem(path)
    with fs.open_input_stream(inside, compression=None) as f:
        while part := f.read(PIECE):
            yield part


def files(path: str, *endings: str) -> list[str]:
    """``path`` itself, or the files in it with one of these endings."""
    from pyarrow.fs import FileSelector, FileType

    fs, inside = filesystem(path)
    if fs.get_file_info(inside).type != FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in fs.get_file_info(FileSelector(inside)) if x.type == FileType.File and x.base_name.endswith(endings))
