"""zstandard raw-content dictionaries and compressed lengths of small inputs."""

from __future__ import annotations

import random

import numpy as np
import zstandard as zs

#: Every window starts with this text, and every dictionary holds it, so that even a
#: window of one word is stored as a compressed block and lengths stay comparable.
FRAME = b"0123456789abcdefghij:"


def expander(k: int, seed: int = 11):
    """A function that writes each byte as k bytes.

    A length in whole bytes is too coarse for single words. Where literals cost k times as
    much and a match costs what it did, the difference of two dictionaries stands out.
    """
    rnd = random.Random(seed)
    perms = [rnd.sample(range(256), 256) for _ in range(k)]
    wide = {b: "".join(chr(p[b]) for p in perms) for b in range(256)}
    return lambda s: s.decode("latin-1").translate(wide).encode("latin-1")


def compressor(content: bytes, level: int | None = None, strategy: int = zs.STRATEGY_BTOPT, min_match: int = 4) -> zs.ZstdCompressor:
    """A compressor with `content` as its raw dictionary, without headers that vary."""
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    bare = {"write_content_size": 0, "write_dict_id": 0, "write_checksum": 0}
    if level is None:
        p = zs.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=min_match, target_length=64, strategy=strategy, **bare)
        d.precompute_compress(compression_params=p)
    else:
        p = zs.ZstdCompressionParameters.from_level(level, **bare)
        d.precompute_compress(level=level)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(c: zs.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """Compressed length of each window; one call into C for all of them."""
    if not windows:
        return np.zeros(0, dtype=np.int64)
    return np.fromiter((len(x) for x in c.multi_compress_to_buffer(windows, threads=0)), dtype=np.int64, count=len(windows))
