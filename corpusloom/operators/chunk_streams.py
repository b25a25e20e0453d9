"""The structural chunkers over one text, as generators: beside the text only the open chunk is held.

Every chunker yields (text, index, start, end, section) in text order and takes
time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

from corpusloom.functions.text import BLANK_LINES, SENTENCE_END

Chunk = tuple[str, int, int, int, str]

# fixed values: a heading line, and the separators from coarse to fine
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
RECURSIVE_SEPARATORS = [r"\n#{1,6}\s+", r"\n\n+", r"(?<=[。！？.!?])\s*", r"\n", r"\s+"]

_SENTENCE = re.compile(SENTENCE_END + r"\s*")
_SEPARATORS = [re.compile(s) for s in RECURSIVE_SEPARATORS]
_BLANK = re.compile(BLANK_LINES)


class Places:
    """Where strings occur in a text: first by a search nearby, then through an index of its 16-grams."""

    HEAD, NEAR = 16, 4096

    def __init__(self, text: str):
        self.text, self._index = text, None

    def find(self, part: str, at: int = 0) -> int:
        """The first place from ``at`` on, -1 if there is none."""
        stop = at + self.NEAR + len(part)
        near = self.text.find(part, at, stop)
        if near >= 0 or stop >= len(self.text):
            return near
        if len(part) < self.HEAD:
            return self.text.find(part, at)
        if self._index is None:
            hashes = self._hashes(self.text)
            order = np.argsort(hashes, kind="stable")
            self._index = hashes[order], order
        hashes, order = self._index
        key = self._hashes(part[: self.HEAD])[0]
        places = order[np.searchsorted(hashes, key, "left") : np.searchsorted(hashes, key, "right")]
        for place in places[np.searchsorted(places, at) :]:
            if self.text.startswith(part, int(place)):
                return int(place)
        return -1

    def _hashes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(codes) - self.HEAD + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.HEAD):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
        return total


def clean(text: str) -> str:
    return re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def _pieces(text: str, separator: re.Pattern) -> Iterator[str]:
    """What stands between the separators, blank pieces left out."""
    at = 0
    for found in chain(separator.finditer(text), [None]):
        piece = text[at : found.start() if found else len(text)]
        if piece.strip():
            yield piece
        at = found.end() if found else at


def sentences(text: str) -> Iterator[str]:
    at = 0
    for found in chain(_SENTENCE.finditer(text), [None]):
        piece = text[at : found.end(1) if found else len(text)].strip()
        if piece:
            yield piece
        at = found.end() if found else at


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(title, body) per heading; what stands before the first one has no title. A text without headings is one section."""
    title, at = None, 0
    for found in HEADING.finditer(text):
        body = text[at : found.start()].strip()
        if title or body:
            yield title or "", body
        title, at = found.group(2).strip(), found.end()
    body = text[at:].strip() if title is not None else text
    if title is None or title or body:
        yield title or "", body


def _carried(parts: list[str], overlap: int) -> list[str]:
    """The longest run of trailing parts of at most ``overlap`` characters."""
    kept, chars = len(parts), 0
    while overlap > 0 and kept and chars + len(parts[kept - 1]) <= overlap:
        kept -= 1
        chars += len(parts[kept])
    return parts[kept:]


def _packed_sentences(paragraph: str, prefix: str, size: int) -> Iterator[str]:
    held, chars = [], len(prefix)
    for sentence in sentences(paragraph):
        if held and chars + len(sentence) > size:
            yield prefix + " ".join(held)
            held = held[-1:]
            chars = len(prefix) + len(held[0])
        held.append(sentence)
        chars += len(sentence)
    if held:
        yield prefix + " ".join(held)


def _packed_paragraphs(title: str, body: str, cfg) -> Iterator[str]:
    prefix = f"## {title}\n\n" if title else ""
    held, chars = [], 0
    for paragraph in map(str.strip, _pieces(body, _BLANK)):
        long = len(paragraph) > cfg.max_size
        if held and (long or chars + len(paragraph) + len(prefix) > cfg.size):
            yield prefix + "\n\n".join(held)
            held = _carried(held, cfg.overlap)
            chars = sum(map(len, held))
        if long:
            yield from _packed_sentences(paragraph, prefix, cfg.size)
            held, chars = [], 0
        else:
            held.append(paragraph)
            chars += len(paragraph)
    last = prefix + "\n\n".join(held)
    if held and len(last) >= cfg.min_size:
        yield last


def markdown_chunks(text: str, cfg) -> Iterator[Chunk]:
    """Sections, then paragraphs, then sentences of overlong paragraphs; a chunk starts where its section's text first occurs."""
    text = clean(text)
    places, index = Places(text), 0
    for title, body in sections(text):
        start = places.find(body) if body else 0
        for piece in _packed_paragraphs(title, body, cfg):
            yield piece, index, start, start + len(piece), title
            index += 1


def _split(text: str, level: int, cfg) -> Iterator[str]:
    """Pieces of at most ``size`` characters, trying separators from ``level`` on."""
    if len(text) <= cfg.size:
        if text.strip():
            yield text
        return
    if level == len(_SEPARATORS):
        for at in range(0, len(text), cfg.step):
            if text[at : at + cfg.size].strip():
                yield text[at : at + cfg.size]
        return
    pieces = _pieces(text, _SEPARATORS[level])
    first = [p for p in (next(pieces, None), next(pieces, None)) if p is not None]
    held = ""
    # a separator that yields a single piece is skipped: the text itself goes on
    for piece in chain(first, pieces) if len(first) > 1 else [text]:
        if len(held) + len(piece) <= cfg.size:
            held += piece
            continue
        if held:
            yield held
        held = piece
        if len(piece) > cfg.size:
            yield from _split(piece, level + 1, cfg)
            held = ""
    if held:
        yield held


def recursive_chunks(text: str, cfg) -> Iterator[Chunk]:
    """Coarse-to-fine separators; an index counts raw pieces, so it has gaps."""
    text = clean(text)
    places, at = Places(text), 0
    for index, piece in enumerate(_split(text, 0, cfg)):
        said = piece.strip()
        if len(said) < cfg.min_size:
            continue
        found = places.find(piece, at)
        start = found if found >= 0 else at
        at = start + len(piece)
        yield said, index, start, at, ""


def neighbour_similarity(encode: Callable[[list[str]], np.ndarray], flat: list[str], step: int = 4096) -> np.ndarray:
    """Cosine of each sentence with the next, encoded in blocks; rounded, so that equal neighbours stay equal whatever the order of summation."""
    out, last = [np.empty(0)], None
    for at in range(0, len(flat), step):
        rows = np.asarray(encode(flat[at : at + step]), dtype=np.float64)
        if last is not None:
            rows = np.concatenate([last, rows])
        norm = np.linalg.norm(rows, axis=1)
        out.append(np.round((rows[:-1] * rows[1:]).sum(axis=1) / (norm[:-1] * norm[1:] + 1e-8), 12))
        last = rows[-1:]
    return np.concatenate(out)


def _percentile(values: np.ndarray, q: float) -> float:
    ordered = np.sort(values)
    at = (len(ordered) - 1) * q
    low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
    return low + (high - low) * (at - np.floor(at))


def semantic_chunks(text: str, sents: list[str], sims: np.ndarray, cfg) -> Iterator[Chunk]:
    """Cuts where neighbouring sentences differ most, within the size limits; ``text`` is clean, ``sents`` its sentences."""
    if len(sents) <= 1:
        yield text, 0, 0, len(text), ""
        return
    limit = max(_percentile(sims, 0.2), cfg.threshold)
    places, at, index, held, chars = Places(text), 0, 0, [sents[0]], len(sents[0])

    def close() -> Chunk:
        nonlocal at, index
        body = " ".join(held)
        found = places.find(held[0], at)
        start = found if found >= 0 else at
        at, index = start + len(body), index + 1
        return body, index - 1, start, at, ""

    for sentence, sim in zip(sents[1:], sims, strict=True):
        chars += len(sentence)
        # after a cut the length restarts at zero: the sentence that opens the group is not counted
        if (sim < limit and chars >= cfg.min_size) or chars >= cfg.max_size:
            yield close()
            held, chars = [], 0
        held.append(sentence)
    yield close()


def encoded_chunks(texts: Iterable[str], encode: Callable[[list[str]], np.ndarray], cfg) -> Iterator[Iterator[Chunk]]:
    """Semantic chunks of several texts with their sentences encoded together; a text whose encoding fails is cut recursively."""
    cleaned = [clean(t) for t in texts]
    split = [list(sentences(t)) for t in cleaned]
    ends = np.cumsum([len(s) for s in split]).tolist()
    try:
        flat = neighbour_similarity(encode, [s for sents in split for s in sents])
        sims = [flat[end - len(s) : max(end - 1, end - len(s))] for s, end in zip(split, ends, strict=True)]
    except Exception:  # noqa: BLE001 - any failure of the model; one text alone shows whose it is
        if len(split) > 1:
            half = len(cleaned) // 2
            for part in (cleaned[:half], cleaned[half:]):
                yield from encoded_chunks(part, encode, cfg)
            return
        sims = [None]
    for text, sents, sim in zip(cleaned, split, sims, strict=True):
        if sim is None and len(sents) > 1:
            yield recursive_chunks(text, cfg)
        else:
            yield semantic_chunks(text, sents, sim, cfg)
