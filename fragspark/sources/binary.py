"""BAM and 2bit files as Spark data sources, and an unpaired BAM writer; standard library only.

``spark.dataSource.register(BamSource)`` then ``spark.read.format("bam").load(path)`` gives aligned reads. A BAM is cut
into stretches of compressed blocks: each task finds the first block of its stretch by its header and, from there, the first
record by its fields' consistency, and reads records until the stretch ends.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Compressed bytes of a stretch.
STRETCH = 16 << 20
READ_SCHEMA = (
    "chrom string, qname string, flag int, pos long, end_pos long, mapq int, cigar string, mate_chrom string, mate_pos long, "
    "insert_size long, seq string, qual binary, gc_tag double"
)
# fixed values of the formats
_CIGAR, _BASES, _EOF = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def block_size(head: bytes) -> int | None:
    """Whole size of the BGZF block that begins with these 18 bytes, None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack("<H", head[16:18])[0] + 1


def blocks(f, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the blocks that begin in [start, stop); start must be a block's."""
    at = start
    while stop is None or at < stop:
        f.seek(at)
        head = f.read(18)
        if not head:
            return
        size = block_size(head)
        if size is None:
            raise ValueError(f"no BGZF block at {at}")
        yield at, zlib.decompress((head + f.read(size - 18))[18:-8], -15)
        at += size


def first_block(f, start: int, limit: int) -> int | None:
    """Offset of the first block at or behind start whose successor is a block as well (or the file's end)."""
    f.seek(start)
    data = f.read(min(limit - start, 1 << 17) + 18)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        size = block_size(data[at : at + 18])
        if size:
            f.seek(start + at + size)
            after = f.read(18)
            if not after or block_size(after):
                return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def header(f) -> tuple[list[tuple[str, int]], int, int]:
    """Contigs (name, length), and where records begin: block offset and place in the block."""
    data, ends = b"", []
    for at, block in blocks(f, 0):
        ends.append((at, len(data)))
        data += block
        if len(data) < 12:
            continue
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        text = struct.unpack_from("<i", data, 4)[0]
        if len(data) < 12 + text:
            continue
        n, place, contigs = struct.unpack_from("<i", data, 8 + text)[0], 12 + text, []
        try:
            for _ in range(n):
                size = struct.unpack_from("<i", data, place)[0]
                name = data[place + 4 : place + 3 + size].decode()
                contigs.append((name, struct.unpack_from("<i", data, place + 4 + size)[0]))
                place += 8 + size
        except struct.error:
            continue
        if place > len(data):
            continue
        block_at, base = max(e for e in ends if e[1] <= place)
        return contigs, block_at, place - base
    raise ValueError("the BAM header is cut off")


def plausible(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """Where the next record begins if a record can begin here, else None."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 or name < 1 or n_seq < 0 or not -1 <= ref < len(contigs) or not -1 <= mate < len(contigs):
        return None
    if pos < -1 or mate_pos < -1 or ref >= 0 and pos > contigs[ref][1] or 32 + name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return None
    end = at + 36 + name - 1
    if end < len(data) and (data[end] or 0 in data[at + 36 : end]):
        return None
    return at + 4 + size


def _tag_gc(data: bytes, at: int, stop: int) -> float | None:
    while at + 3 <= stop:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in _TAG_SIZES:
            if tag == b"GC":
                code = {"f": "f", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}.get(kind)
                return float(struct.unpack_from(f"<{code}", data, at)[0]) if code else None
            at += _TAG_SIZES[kind]
        elif kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _TAG_SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            return None
    return None


def record(data: bytes, at: int, contigs: list[tuple[str, int]]) -> tuple:
    size, ref, pos, name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, insert = struct.unpack_from("<iiiBBHHHiiii", data, at)
    p = at + 36
    qname = data[p : p + name - 1].decode()
    p += name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    packed = data[p : p + (n_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
    p += (n_seq + 1) // 2
    qual = data[p : p + n_seq]
    span = sum(o >> 4 for o in ops if _CIGAR[o & 15] in "MDN=X")
    gc = _tag_gc(data, p + n_seq, at + 4 + size)
    chrom = lambda i: contigs[i][0] if i >= 0 else None
    return chrom(ref), qname, flag, pos, pos + span, mapq, "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops), chrom(mate), mate_pos, insert, seq, qual, gc


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


def _files(path: str, suffix: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(suffix))
    return [path]


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = _files(options["path"], ".bam")
        self.stretch = int(options.get("stretch", STRETCH))

    def partitions(self):
        return [Stretch(p, at, at + self.stretch) for p in self.files for at in range(0, os.path.getsize(p), self.stretch)]

    def read(self, partition: Stretch):
        with open(partition.path, "rb") as f:
            contigs, block_at, place = header(f)
            start = block_at if partition.start <= block_at else first_block(f, partition.start, partition.stop)
            if start is None or start >= partition.stop:
                return
            data, at, owned = b"", place if start == block_at else None, 0  # records that begin before ``owned`` are this task's
            for offset, block in blocks(f, start):
                mine = offset < partition.stop
                data += block
                if mine:
                    owned = len(data)
                if at is None:
                    at = self._first(data, contigs)
                    if at is None:
                        continue
                while at < owned and at + 4 <= len(data) and at + 4 + struct.unpack_from("<i", data, at)[0] <= len(data):
                    row = record(data, at, contigs)
                    at += 4 + struct.unpack_from("<i", data, at)[0]
                    if row[0] is not None:
                        yield row
                if not mine and at >= owned:
                    return
                data, owned, at = data[at:], owned - at, 0

    def _first(self, data: bytes, contigs) -> int | None:
        """The first place from which records follow one another to the end of the data at hand."""
        for at in range(len(data) - 36):
            p, n = at, 0
            while p is not None and p + 36 <= len(data) and n < 8:
                p = plausible(data, p, contigs)
                n += 1
            if p is not None and (n == 8 or n and p >= len(data) - 36):
                return at
        return None


class BamSource(DataSource):
    """``format("bam")``: aligned reads of a BAM file or a folder of them; unplaced reads are left out."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, [f.name for f in schema])


def contigs_of(path: str) -> list[tuple[str, int]]:
    """(name, length) of a BAM's contigs, in header order."""
    with open(path, "rb") as f:
        return header(f)[0]


def _compressed(data: bytes) -> bytes:
    out = []
    for at in range(0, len(data), 65_280):
        part = data[at : at + 65_280]
        tool = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = tool.compress(part) + tool.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _bin(a: int, b: int) -> int:
    """The format's index bin of [a, b)."""
    b -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if a >> shift == b >> shift:
            return base + (a >> shift)
    return 0


def unpaired_record(ref: int, start: int, end: int, mapq: int, strand: str, name: str, tags: dict[str, float]) -> bytes:
    """A fragment as one read: all N, quality 40, one match of its length, reversed if '-'."""
    n = end - start
    label = name.encode() + b"\0"
    extra = b"".join(k.encode() + b"f" + struct.pack("<f", v) for k, v in tags.items() if v is not None)
    body = struct.pack("<iiBBHHHiiii", ref, start, len(label), min(mapq, 254), _bin(start, end), 1, 16 if strand == "-" else 0, n, -1, -1, 0)
    body += label + struct.pack("<I", n << 4) + b"\xff" * (n // 2) + b"\xf0" * (n % 2) + bytes([40]) * n + extra
    return struct.pack("<i", len(body)) + body


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class BamWriter(DataSourceWriter):
    """Writes fragments(chrom, start_pos, end_pos[, mapq, strand, gc_weight, coverage_scaling_weight, count_scaling_weight]) as one BAM per task.

    Option ``contigs`` is 'name:length,...'. Sort by chromosome order, start and end within partitions beforehand. Tasks
    write beside the final name; the driver renames all parts once all are complete.
    """

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.names = options["path"], names
        self.contigs = [(n, int(size)) for n, size in (x.rsplit(":", 1) for x in options["contigs"].split(","))]

    def write(self, rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        temp = os.path.join(self.path, f"part-{task.partitionId():05d}.bam.{task.taskAttemptId()}")
        at = {n: i for i, (n, _) in enumerate(self.contigs)}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.contigs)
        head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.contigs))
        head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.contigs)
        with open(temp, "wb") as f:
            f.write(_compressed(head))
            held: list[bytes] = []
            for k, row in enumerate(rows):
                r = dict(zip(self.names, row))
                tags = {"fl": None, "GC": r.get("gc_weight"), "cw": r.get("coverage_scaling_weight"), "nw": r.get("count_scaling_weight")}
                held.append(unpaired_record(at[r["chrom"]], r["start_pos"], r["end_pos"], r.get("mapq") or 0, r.get("strand") or "+", f"f{task.partitionId()}.{k}", tags))
                if len(held) == 4096:
                    f.write(_compressed(b"".join(held)))
                    held = []
            f.write(_compressed(b"".join(held)) + _EOF)
        return _Written(temp)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.rsplit(".", 1)[0])

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


# --- 2bit


def twobit_index(path: str) -> list[tuple[str, int, int]]:
    """(name, length, offset) of each sequence."""
    with open(path, "rb") as f:
        magic, _, n, _ = struct.unpack("<IIII", f.read(16))
        if magic != 0x1A412743:
            raise ValueError("not a little-endian 2bit file")
        entries = []
        for _ in range(n):
            name = f.read(f.read(1)[0]).decode()
            entries.append((name, struct.unpack("<I", f.read(4))[0]))
        out = []
        for name, at in entries:
            f.seek(at)
            out.append((name, struct.unpack("<I", f.read(4))[0], at))
    return out


def twobit_bases(path: str, offset: int, start: int, stop: int) -> str:
    """Upper-case bases of [start, stop) of the sequence at an offset."""
    with open(path, "rb") as f:
        f.seek(offset)
        size, n = struct.unpack("<II", f.read(8))
        starts, sizes = struct.unpack(f"<{n}I", f.read(4 * n)), struct.unpack(f"<{n}I", f.read(4 * n))
        masks = struct.unpack("<I", f.read(4))[0]
        base = f.tell() + 8 * masks + 4
        stop = min(stop, size)
        if start >= stop:
            return ""
        f.seek(base + start // 4)
        packed = f.read((stop + 3) // 4 - start // 4)
    seq = bytearray(b for x in packed for b in (b"TCAG"[x >> 6], b"TCAG"[x >> 4 & 3], b"TCAG"[x >> 2 & 3], b"TCAG"[x & 3]))
    seq = seq[start % 4 : start % 4 + stop - start]
    for a, m in zip(starts, sizes):
        lo, hi = max(a, start), min(a + m, stop)
        if lo < hi:
            seq[lo - start : hi - start] = b"N" * (hi - lo)
    return seq.decode()


class TwoBitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.overlap = options["path"], int(options.get("chunk", 4096)), int(options.get("overlap", 0))
        self.together = max(1, int(options.get("bases", 8 << 20)) // self.size)

    def partitions(self):
        out = []
        for name, length, offset in twobit_index(self.path):
            step = self.together * self.size
            out += [Stretch(f"{name}\0{offset}", a, min(length, a + step)) for a in range(0, length, step)]
        return out

    def read(self, partition: Stretch):
        name, offset = partition.path.split("\0")
        seq = twobit_bases(self.path, int(offset), partition.start, partition.stop + self.overlap)
        for at in range(partition.start, partition.stop, self.size):
            k = at - partition.start
            yield name, at, seq[k : k + self.size + self.overlap]


class TwoBitSource(DataSource):
    """``format("twobit")``: chunks (chrom, chunk_start, seq); options chunk, overlap."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chrom string, chunk_start long, seq string"

    def reader(self, schema):
        return TwoBitReader(self.options)
