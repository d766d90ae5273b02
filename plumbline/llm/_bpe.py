"""Byte-level BPE vocabularies and encoders, kept per worker process."""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np
import tiktoken

from plumbline.llm import _kernels as K


def ranks_from_rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_from_json(path: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Ranks and added tokens of a byte-level BPE file of ``tokenizers``.

    Its tokens are written with one printable character per byte. Ids must
    follow the order of the merges, which makes them ranks. Added tokens are
    found in raw text before anything else; those that also take white space
    or ask for word ends are not supported.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = file["added_tokens"]
    if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: an added token takes more than its text")
    special = {t["content"]: t["id"] for t in added}
    vocab = file["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError(f"{path}: ids do not follow the merges")
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return ranks, {token.encode(): i for token, i in special.items()}


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(key: str, pattern: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """One encoder per vocabulary and process."""
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


class PieceCache:
    """Ids of pre-tokens as bytes of 32-bit numbers. Each distinct pre-token is
    encoded once while it is kept; what is kept holds about ``limit`` bytes."""

    #: Bytes of a dictionary entry and its two bytes objects, besides their contents.
    ENTRY = 180

    def __init__(self, enc: tiktoken.Encoding, limit: int = 16 << 20):
        self.encode = enc._core_bpe.encode_single_piece
        self.known: dict[bytes, bytes] = {}
        self.held, self.limit = 0, limit

    def ids(self, piece: bytes) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = array("I", self.encode(piece)).tobytes()
            self.held += len(piece) + len(found) + self.ENTRY
            if self.held > self.limit:
                self.known.clear()
                self.held = len(piece) + len(found) + self.ENTRY
            self.known[piece] = found
        return found


def split_at(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of all texts, cut around added tokens; the
    id of each part that is one (-1 for the others); and each text's first part,
    with one more at the end. The leftmost token counts, and of several there
    the longest."""
    data = raw.tobytes()
    find = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    if find is None or not find.search(data):
        return starts, ends, np.full(len(starts), -1), np.arange(len(starts) + 1)
    parts: list[tuple[int, int, int]] = []
    head = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        head.append(len(parts))
        at = a
        for m in find.finditer(data, a, b):
            parts += [(at, m.start(), -1), (*m.span(), added[m[0]])]
            at = m.end()
        parts.append((at, b, -1))
    low, high, which = np.array(parts, np.int64).T
    return low, high, which, np.array([*head, len(parts)])


def encode_texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cache: PieceCache, added: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids start."""
    low, high, which, head = split_at(raw, starts, ends, added or {})
    at, first = K.pretokens(raw, low, high)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
    stop = np.append(at[1:], len(raw))
    _, sample, inverse = np.unique(K.span_hashes(raw, at, stop), return_index=True, return_inverse=True)
    data = raw.tobytes()
    pieces = [cache.ids(data[a:b]) for a, b in zip(at[sample].tolist(), stop[sample].tolist())]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), np.uint32)
    flat_at = np.cumsum(size) - size
    sizes = size[inverse]
    total = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat[np.arange(total[-1]) + np.repeat(flat_at[inverse] - total[:-1], sizes)]
    begin = total[first]
    if (which >= 0).any():
        # A part that is an added token is one id.
        n = np.diff(begin)
        keep = np.repeat(which < 0, n)
        one = begin[:-1][which >= 0]
        keep[one] = True
        ids = ids.copy()
        ids[one] = which[which >= 0]
        ids = ids[keep]
        begin = np.concatenate([[0], np.cumsum(np.where(which < 0, n, 1))])
    return ids, begin[head]
