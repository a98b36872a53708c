"""Parsers and writers of the file formats, on bytes."""

from __future__ import annotations

import base64
import gzip
import io
import struct
import xml.etree.ElementTree as ET
import zlib
from xml.sax.saxutils import escape

import numpy as np

#: Fixed values of NIfTI-1, TRK and GIFTI.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
TRK_HEADER, NIFTI_HEADER = 1000, 348


def parse_tck(data: bytes) -> list[np.ndarray]:
    """Curves of a TCK file: a text header, then triples; a triple of NaN ends a curve, one of infinities the file."""
    if not data.startswith(b"mrtrix tracks"):
        raise ValueError("not a TCK file")
    head = data[: data.index(b"END")].decode("latin-1")
    fields = dict(line.split(": ", 1) for line in head.split("\n")[1:] if ": " in line)
    kind = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}.get(fields.get("datatype", "").strip())
    if kind is None:
        raise ValueError(f"TCK datatype {fields.get('datatype')!r}")
    start = int(fields["file"].split()[1])
    n = (len(data) - start) // (3 * np.dtype(kind).itemsize)
    points = np.frombuffer(data, kind, 3 * n, start).reshape(n, 3).astype(float)
    stop = np.flatnonzero(np.isinf(points).all(axis=1))
    points = points[: stop[0]] if len(stop) else points
    ends = np.flatnonzero(np.isnan(points).all(axis=1))
    return [points[a:b] for a, b in zip(np.concatenate(([0], ends + 1)), np.append(ends, len(points)), strict=True) if b > a]


def make_tck(curves: list[np.ndarray]) -> bytes:
    head = "mrtrix tracks\ndatatype: Float32LE\ncount: %d\nfile: . %d\nEND\n"
    start = len(head % (len(curves), 100))
    start = len(head % (len(curves), start))
    rows = [x for c in curves for x in (np.asarray(c, "<f4"), np.full((1, 3), np.nan, "<f4"))] + [np.full((1, 3), np.inf, "<f4")]
    return (head % (len(curves), start)).encode() + np.concatenate(rows).tobytes()


def parse_trk(data: bytes, space: str = "world") -> list[np.ndarray]:
    """Curves of a TRK file, in world millimetres by its voxel-to-world matrix or as stored (space="stored")."""
    if data[:5] != b"TRACK" or len(data) < TRK_HEADER:
        raise ValueError("not a TRK file")
    order = "<" if struct.unpack_from("<i", data, 996)[0] == TRK_HEADER else ">"
    size = np.frombuffer(data, f"{order}f4", 3, 12).astype(float)
    scalars, properties = (struct.unpack_from(f"{order}h", data, at)[0] for at in (36, 238))
    matrix = np.frombuffer(data, f"{order}f4", 16, 440).reshape(4, 4).astype(float)
    at, out = TRK_HEADER, []
    while at + 4 <= len(data):
        n = struct.unpack_from(f"{order}i", data, at)[0]
        points = np.frombuffer(data, f"{order}f4", n * (3 + scalars), at + 4).reshape(n, -1)[:, :3].astype(float)
        if space == "world" and matrix[3, 3]:
            points = (points / np.where(size == 0, 1, size) - 0.5) @ matrix[:3, :3].T + matrix[:3, 3]
        out.append(points)
        at += 4 + 4 * (n * (3 + scalars) + properties)
    return out


def make_trk(curves: list[np.ndarray], size=(1.0, 1.0, 1.0), matrix: np.ndarray | None = None) -> bytes:
    head = bytearray(TRK_HEADER)
    head[:5] = b"TRACK"
    struct.pack_into("<3f", head, 12, *size)
    matrix = np.eye(4) if matrix is None else matrix
    struct.pack_into("<16f", head, 440, *np.asarray(matrix, float).ravel())
    struct.pack_into("<3i", head, 988, len(curves), 2, TRK_HEADER)
    inverse = np.linalg.inv(matrix)
    body = [bytes(head)]
    for c in curves:
        p = (np.asarray(c, float) @ inverse[:3, :3].T + inverse[:3, 3] + 0.5) * np.asarray(size)
        body += [struct.pack("<i", len(p)), p.astype("<f4").tobytes()]
    return b"".join(body)


def parse_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(volume, affine): the sform if it is set, else the qform, else the voxel sizes."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack_from("<i", data)[0] == NIFTI_HEADER else ">"
    if struct.unpack_from(f"{order}i", data)[0] != NIFTI_HEADER:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", data, 40)
    kind = NIFTI_TYPES.get(struct.unpack_from(f"{order}h", data, 70)[0])
    if kind is None:
        raise ValueError("NIfTI datatype")
    pixdim = struct.unpack_from(f"{order}8f", data, 76)
    offset, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
    qform, sform = struct.unpack_from(f"{order}2h", data, 252)
    shape = [max(1, n) for n in dim[1 : 1 + dim[0]]]
    volume = np.frombuffer(data, order + kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    volume = volume * slope + inter if slope not in (0.0, 1.0) or inter else volume
    affine = np.diag([*pixdim[1:4], 1.0])
    if sform > 0:
        affine = np.vstack([np.frombuffer(data, f"{order}f4", 12, 280).reshape(3, 4), [0, 0, 0, 1]]).astype(float)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack_from(f"{order}6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        affine[:3, 3] = x, y, z
    return volume, affine


def make_nifti(volume: np.ndarray, affine: np.ndarray) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, NIFTI_HEADER)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape, *[1] * (7 - volume.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    head[280:328] = np.asarray(affine[:3], "<f4").tobytes()
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.asarray(volume, "<f4").tobytes(order="F"))


def parse_gifti(data: bytes) -> tuple[list[np.ndarray], dict[int, tuple]]:
    """(arrays, labels): the data arrays in order, and the label table: key -> (name, r, g, b, a)."""
    root = ET.fromstring(data)
    arrays = []
    for a in root.findall("DataArray"):
        kind = GIFTI_TYPES[a.get("DataType")]
        shape = [int(a.get(f"Dim{i}")) for i in range(int(a.get("Dimensionality")))]
        text, coding = a.findtext("Data") or "", a.get("Encoding")
        if coding == "ASCII":
            flat = np.array(text.split(), kind)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if coding == "GZipBase64Binary" else raw
            flat = np.frombuffer(raw, (">" if a.get("Endian") == "BigEndian" else "<") + kind)
        arrays.append(flat.reshape(shape, order="F" if a.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"))
    labels = {int(x.get("Key")): (x.text or "", *(float(x.get(c, "nan")) for c in ("Red", "Green", "Blue", "Alpha"))) for x in root.findall("LabelTable/Label")}
    return arrays, labels


def make_gifti(arrays: list[tuple[str, np.ndarray]], labels: dict[int, tuple] | None = None, structure: str | None = None) -> bytes:
    """A GIFTI file of (intent, array) pairs with a label table and the primary structure."""
    names = {v: k for k, v in GIFTI_TYPES.items()}
    out = io.StringIO()
    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<GIFTI Version="1.0" NumberOfDataArrays="{len(arrays)}">\n<MetaData>')
    if structure:
        out.write(f"<MD><Name>AnatomicalStructurePrimary</Name><Value>{escape(structure)}</Value></MD>")
    out.write("</MetaData>\n<LabelTable>")
    for key, (name, r, g, b, a) in sorted((labels or {}).items()):
        out.write(f'<Label Key="{key}" Red="{r}" Green="{g}" Blue="{b}" Alpha="{a}">{escape(name)}</Label>')
    out.write("</LabelTable>\n")
    for intent, x in arrays:
        dims = " ".join(f'Dim{i}="{n}"' for i, n in enumerate(x.shape))
        packed = base64.b64encode(zlib.compress(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes())).decode()
        out.write(f'<DataArray Intent="{intent}" DataType="{names[x.dtype.str[1:]]}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="{x.ndim}" {dims} Encoding="GZipBase64Binary" Endian="LittleEndian" ExternalFileName="" ExternalFileOffset=""><Data>{packed}</Data></DataArray>\n')
    out.write("</GIFTI>\n")
    return out.getvalue().encode()


def parse_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npy_head(shape: tuple[int, ...]) -> bytes:
    """What stands before the entries of an array of float64 in row order."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": shape})
    return out.getvalue()
