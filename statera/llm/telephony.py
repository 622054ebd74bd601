"""Telephony audio columns: G.711 mu-law and A-law by lookup, IMA ADPCM across blocks, resampled PCM.

Audio is stored as WAV files in a binary column, 8 kHz mono, in one of three formats.  Decoding is vectorised over all
files of an Arrow batch: mu-law and A-law codes index a table of 256 samples; ADPCM blocks, which are independent of
each other, are decoded side by side, one numpy step per nibble position for all blocks at once.  :func:`decode` returns
PCM at another rate (means of whole groups of samples where the rate goes down by a whole factor, else linear
interpolation) and :func:`store_pcm` writes it; memory is bounded by the decoding of about ``textblocks.BLOCK_BYTES`` of
codes, or of one file where that is longer.  The query stores files and PCM at ``LOW_RATE`` and computes features of the
PCM that it reads back; at 8 kHz or more the PCM alone would be two to eight times the text.

Defined results: null and empty payloads are padded like any other; a null or malformed WAV has no PCM (null), and
``codec`` null; repeated rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textblocks import blocks, flat

RATE = 8000
LOW_RATE = 2000
BLOCK = 192  # payload bytes of an ADPCM block; its header has four more
CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}

# fixed values of the IMA ADPCM format: step sizes and index changes
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, size + 8, (size + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next index, by index * 16 + nibble."""
    index, nibble = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -change, change), np.clip(index + INDEX_CHANGE[nibble & 7], 0, len(STEPS) - 1)


MULAW, ALAW = _mulaw_table(), _alaw_table()
CHANGE, NEXT = _adpcm_tables()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of all ADPCM blocks (rows of ``data``: 4 header bytes, then nibbles, low first), decoded side by side."""
    n, width = data.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample = np.ascontiguousarray(data[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(data[:, 2], len(STEPS) - 1).astype(np.int64)
    out[0] = sample
    codes = np.ascontiguousarray(data[:, 4:].T)
    for k in range(width - 4):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + CHANGE[at], -32768, 32767)
            index = NEXT[at]
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file whose samples are the payload's bytes; for ADPCM, blocks of 192 payload bytes with a zero header."""
    if codec == "adpcm":
        rows = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
        rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data, per_block = rows.tobytes(), 1 + 2 * BLOCK
        samples, align, bits, rate = len(rows) * per_block, BLOCK + 4, 4, RATE * (BLOCK + 4) // per_block
    else:
        data, samples, align, bits, rate, per_block = payload, len(payload), 1, 8, RATE, 0
    form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, rate, align, bits, 2 if per_block else 0)
    form += struct.pack("<H", per_block) if per_block else b""
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def read_wav(file: bytes | None) -> tuple[str, memoryview] | None:
    """(codec, data chunk) of a WAV file in one of the three formats, or None."""
    if not file or len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, codec, align = 12, None, 1
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, _, _, _, align = struct.unpack_from("<HHIIH", file, at + 8)
            codec = next((c for c, t in TAGS.items() if t == tag), None)
        elif name == b"data":
            data = memoryview(file)[at + 8 : at + 8 + size]
            whole = codec and len(data) == size and (codec != "adpcm" or align == BLOCK + 4 and size % align == 0)
            return (codec, data) if whole else None
        at += 8 + size + size % 2
    return None


def payload(codec: str, data) -> bytes:
    """The bytes that :func:`wav` was given."""
    if codec != "adpcm":
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)[:, 4:].tobytes()


def decode_files(files: list[tuple[str, memoryview]]) -> list[np.ndarray]:
    """PCM at 8 kHz of each (codec, data); all files of a format are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    for codec in CODECS:
        mine = [k for k, (c, _) in enumerate(files) if c == codec]
        if mine:
            codes = np.concatenate([np.frombuffer(files[k][1], np.uint8) for k in mine])
            if codec == "adpcm":
                pcm = decode_adpcm(codes.reshape(-1, BLOCK + 4)).reshape(-1)
                sizes = [len(files[k][1]) // (BLOCK + 4) * (1 + 2 * BLOCK) for k in mine]
            else:
                pcm, sizes = (MULAW if codec == "mulaw" else ALAW)[codes], [len(files[k][1]) for k in mine]
            for k, part in zip(mine, np.split(pcm, np.cumsum(sizes)[:-1])):
                out[k] = part
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """n samples become n * to // rate: means where ``to`` divides the rate, else linear interpolation."""
    if rate % to == 0:
        k = rate // to
        return (pcm[: len(pcm) // k * k].reshape(-1, k).sum(1, dtype=np.int32) // k).astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        if len(pcm):
            out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
            out[-1] = pcm[-1]
        return out
    n = len(pcm) * to // rate
    if not n:
        return np.zeros(0, np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // to, at % to
    high = np.minimum(low + 1, len(pcm) - 1)
    return ((pcm[low].astype(np.int64) * (to - part) + pcm[high].astype(np.int64) * part) // to).astype(np.int16)


def features(codec: str, pcm: np.ndarray, rate: int) -> str:
    """codec:rate:samples:rms:peak:zero crossings:crc32 of the PCM as little-endian 16-bit samples."""
    wide = pcm.astype(np.float32)
    rms = float(np.sqrt(np.dot(wide, wide) / max(len(pcm), 1)))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    peak = max(int(pcm.max(initial=0)), -int(pcm.min(initial=0)))
    return f"{codec}:{rate}:{len(pcm)}:{rms:.3e}:{peak}:{crossings}:{zlib.crc32(pcm.astype('<i2', copy=False).data)}"


def _decoded(column: pa.Array, to: int):
    """(codec, payload, PCM at rate ``to``) of each WAV in the column, None for what is no such file."""
    _, offsets = flat(column)
    for lo, hi in blocks(offsets):
        read = [read_wav(x) for x in column.slice(lo, hi - lo).to_pylist()]
        pcm = iter(decode_files([x for x in read if x]))
        for x in read:
            yield x and (x[0], payload(*x), resample(next(pcm), RATE, to))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with spaces to a multiple of 192, as a WAV file.

    The format is chosen by the payload's CRC, so equal texts give equal files.
    """

    def run(batches):
        for batch in batches:
            ids, sizes, media = [], [], []
            data, offsets = flat(batch.column(1))
            for k in range(len(offsets) - 1):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                body = text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK))
                sizes.append(len(text))
                media.append(wav(body, CODECS[zlib.crc32(body) % 3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    inner = docs.select("doc_id", shared.whole_text().alias("text"))
    return inner.mapInArrow(run, f"doc_id {dict(inner.dtypes)['doc_id']}, n_bytes long, media binary")


def decode(media: DataFrame, rate: int = 16_000) -> DataFrame:
    """doc_id, codec, pcm (little-endian 16-bit at ``rate``) of the WAV files in column media."""

    def run(batches):
        for batch in batches:
            found = [x and (x[0], x[2].astype("<i2", copy=False).tobytes()) for x in _decoded(batch.column(1), rate)]
            codec, pcm = ([x and x[k] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec, pa.string()), pa.array(pcm, pa.binary())], names=["doc_id", "codec", "pcm"])

    inner = media.select("doc_id", "media")
    return inner.mapInArrow(run, f"doc_id {dict(inner.dtypes)['doc_id']}, codec string, pcm binary")


def store_pcm(media: DataFrame, path: str, rate: int = 16_000) -> None:
    """Write the resampled PCM of every file as Parquet."""
    decode(media, rate).write.option("compression", "zstd").parquet(path)


def with_pcm(media: DataFrame, rate: int = LOW_RATE) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with codec and pcm, as :func:`decode` makes them."""

    def run(batches):
        for batch in batches:
            found = [x and (x[0], x[2].astype("<i2", copy=False).tobytes()) for x in _decoded(batch.column(2), rate)]
            codec, pcm = ([x and x[k] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codec, pa.string()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "media", "codec", "pcm"])

    inner = media.select("doc_id", "n_bytes", "media")
    return inner.mapInArrow(run, f"doc_id {dict(inner.dtypes)['doc_id']}, n_bytes long, media binary, codec string, pcm binary")


def describe(stored: DataFrame, rate: int = LOW_RATE) -> DataFrame:
    """Payload digests of each file and features of the PCM beside it, both as stored by :func:`with_pcm`."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, codec, pcm in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                read = read_wav(file)
                body = payload(*read) if read else None
                rows.append(read and (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), features(codec, np.frombuffer(pcm, "<i2"), rate)))
            size, sha, tail, text = ([x and x[k] for x in rows] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), batch.column(2), batch.column(4), pa.array(text, pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    inner = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), "media", F.sha2("media", 256).alias("media_sha256"), "codec", "pcm")
    kind = dict(inner.dtypes)["doc_id"]
    return inner.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_telephony(spark, sf_dir: str) -> DataFrame:
    return describe(shared.stored(with_pcm(encode(shared.documents(spark, sf_dir))), "media"))
