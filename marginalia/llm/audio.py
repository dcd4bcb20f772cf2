"""Telephony audio columns: mu-law and A-law by lookup tables, ADPCM blocks with numpy across blocks, resampled PCM.

The two laws' tables are computed from their rule.  ``store`` keeps any bytes
losslessly as mu-law samples in a RIFF/WAVE file, ``load`` reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import chunks, texts_of

#: One ADPCM block, and so the unit that payloads are padded to.
BLOCK = 576
RATE = 8000
#: RIFF format tags of PCM, A-law, mu-law and IMA ADPCM.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
#: The step-index change for a 4-bit ADPCM code without its sign.
INDEX_STEP = (-1, -1, -1, -1, 2, 4, 6, 8)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    magnitude = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -magnitude, magnitude).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    magnitude = np.where(exponent > 0, (mantissa + 264) << np.maximum(exponent - 1, 0), mantissa + 8)
    return np.where(code & 128, magnitude, -magnitude).astype(np.int16)


#: The 89 quantiser steps of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)

MULAW, ALAW = _mulaw(), _alaw()
CHANGE = np.array(INDEX_STEP * 2, np.int32)


def store(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A mono WAVE file whose 8-bit samples are ``payload`` as it is."""
    fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<I", len(payload))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and samples of a WAVE file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without samples")


def expand(samples: bytes, codec: str = "mulaw") -> np.ndarray:
    """16-bit PCM of mu-law or A-law samples, by table."""
    return (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(samples, np.uint8)]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit PCM of mono IMA ADPCM blocks, uint8 of (blocks, bytes): one step for a nibble of all blocks at once.

    A header's step index above 88 counts as 88.  The result has (blocks, 1 + 2 * (bytes - 4)) samples.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    # The predictor's change for each step index and code, so that a step is two lookups.
    step, code = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    change = np.where(code & 8, -change, change).astype(np.int32).ravel()
    after = (np.clip(np.arange(89)[:, None] + CHANGE[None, :], 0, 88) * 16).astype(np.int32).ravel()
    index *= 16
    for k in range(width - 4):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            slot = index + nibble
            value += change.take(slot)
            np.clip(value, -32768, 32767, out=value)
            index = after.take(slot)
            out[1 + 2 * k + half] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate by linear interpolation, the last sample held."""
    wide = np.empty(2 * len(pcm), np.int16)
    wide[0::2] = pcm
    if len(pcm):
        wide[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        wide[-1] = pcm[-1]
    return wide


def padded(text: bytes, unit: int = BLOCK) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def describe(pcm: np.ndarray) -> str:
    """Root mean square, peak and sign changes."""
    x = pcm.astype(np.int64)
    return f"{int(np.sqrt((x * x).mean()))}:{int(np.abs(x).max())}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, media binary, pcm binary, feature string"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _adpcm(payloads: list[bytes]) -> list[np.ndarray]:
    counts = [len(p) // BLOCK for p in payloads]
    pcm = decode_adpcm(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
    return np.split(pcm, np.cumsum(counts)[:-1])


def _rows(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        texts = texts_of(batch.column("text"))
        media = [store(padded(t)) for t in texts]
        read = [load(m) for m in media]
        rows: list[list] = []
        for text, m, (_, rate, samples), adpcm in zip(texts, media, read, _adpcm([x[2] for x in read]), strict=True):
            pcm = expand(samples)
            wide = doubled(pcm)
            feature = f"s={len(samples)};hz={rate};mu={describe(pcm)};a={describe(expand(samples, 'alaw'))};ima={describe(adpcm.ravel())};pcm{2 * rate}={zlib.crc32(wide.tobytes())}"
            if digest:
                rows.append([len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature])
            else:
                rows.append([len(text), len(samples), m, wide.tobytes(), feature])
        names = [x.split()[0] for x in (DIGESTS if digest else SCHEMA).split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in (DIGESTS if digest else SCHEMA).split(", ")]
        columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names)


def media_columns(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Each text as a mu-law WAVE file (``media``), its PCM at 16 kHz (``pcm``) and features of what was read back.

    With ``digest`` the files give way to their lengths and hashes.  A null or empty text is one block of bytes 255; a
    repeated row gives a repeated result; other columns of ``docs`` play no part.  Work is by row, without a shuffle.
    """
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: _rows(it, digest), DIGESTS if digest else SCHEMA)
