"""Model files: a little-endian header length, a JSON header, raw tensors; optionally zstd-compressed. And flat binary folders."""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from ..operators.models import Forest, Svr
from .parts import filesystem

# Fixed values of the format.
KINDS = {"F64": np.float64, "F32": np.float32, "I64": np.int64, "I32": np.int32, "U8": np.uint8, "BOOL": np.bool_}
LISTS = ("gdm_window_sizes", "gdm_half_nWindows", "feature_names")
MAGIC = b"\x28\xb5\x2f\xfd"
TREE = ("nodestatus", "bestvar", "xbestsplit", "left_daughter", "right_daughter", "nodepred")


def read_tensors(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Tensors by name and the metadata: text, but for the entries in LISTS."""
    fs, inside = filesystem(path)
    with fs.open_input_stream(inside, compression=None) as f:
        data = f.read()
    if data[:4] == MAGIC or path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    (n,) = struct.unpack("<Q", data[:8])
    header = json.loads(data[8 : 8 + n])
    meta = header.pop("__metadata__", {})
    meta.update((k, json.loads(meta[k])) for k in LISTS if k in meta)
    body = memoryview(data)[8 + n :]
    return {k: np.frombuffer(body[slice(*t["data_offsets"])], KINDS[t["dtype"]]).reshape(t["shape"]) for k, t in header.items()}, meta


def write_tensors(path: str, tensors: dict[str, np.ndarray], meta: dict[str, object]) -> None:
    kinds = {np.dtype(v): k for k, v in KINDS.items()}
    header: dict = {"__metadata__": {k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()}}
    at = 0
    for k, t in tensors.items():
        header[k] = {"dtype": kinds[t.dtype], "shape": list(t.shape), "data_offsets": [at, at + t.nbytes]}
        at += t.nbytes
    head = json.dumps(header).encode()
    data = struct.pack("<Q", len(head)) + head + b"".join(np.ascontiguousarray(t).tobytes() for t in tensors.values())
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdCompressor().compress(data)
    fs, inside = filesystem(path)
    with fs.open_output_stream(inside, compression=None) as f:
        f.write(data)


def load_svr(path: str) -> Svr:
    t, m = read_folder(path) if os.path.isdir(path) else read_tensors(path)
    number = lambda k: float(m[k])
    return Svr(t["support_vectors"], t["dual_coef"], number("gamma"), number("rho"), t["x_center"], t["x_scale"], number("y_center"), number("y_scale"), tuple(map(int, m["gdm_window_sizes"])), tuple(map(int, m["gdm_half_nWindows"])))


def save_svr(path: str, s: Svr) -> None:
    n = s.support.shape[1]
    full = lambda v: np.broadcast_to(np.asarray(v, float), (n,)).copy()
    meta = {"n_sv": len(s.support), "n_features": n, "gamma": s.gamma, "rho": s.rho, "y_center": s.y_center, "y_scale": s.y_scale, "gdm_window_sizes": list(s.windows), "gdm_half_nWindows": list(s.halves)}
    write_tensors(path, {"support_vectors": s.support, "dual_coef": s.coef, "x_center": full(s.x_center), "x_scale": full(s.x_scale)}, meta)


def load_forest(path: str) -> Forest:
    t, m = read_folder(path) if os.path.isdir(path) else read_tensors(path)
    return Forest(*(t[k] for k in ("nodestatus", "bestvar", "xbestsplit", "left_daughter", "right_daughter", "nodepred")), list(m.get("feature_names", [])))


def save_forest(path: str, f: Forest) -> None:
    ints = lambda a: np.asarray(a, np.int32)
    values = (ints(f.status), ints(f.variable), np.asarray(f.split, float), ints(f.left), ints(f.right), np.asarray(f.prediction, float))
    write_tensors(path, dict(zip(TREE, values)), {"n_trees": f.status.shape[0], "n_nodes": f.status.shape[1], "feature_names": f.names})


def read_folder(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """A folder of name.bin files with meta.json: {"tensors": {name: {"dtype", "shape"}}, other metadata}."""
    with open(f"{path}/meta.json") as f:
        meta = json.load(f)
    shapes = meta.pop("tensors")
    return {k: np.fromfile(f"{path}/{k}.bin", KINDS[v["dtype"]]).reshape(v["shape"]) for k, v in shapes.items()}, meta
