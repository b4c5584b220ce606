"""Token ids of whole texts, each distinct white-space word of a batch once."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words in a string that is encoded at once.
JOINED = 200


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and lower-cases, so that a text's ids are its words' ids in a row.

    Words are cached, in two generations of at most `cap` each. A word that ends in punctuation after a letter is put
    together from the two parts, since the tokenizer always cuts there. Other new words are encoded many in a string, with a
    mark between them, a character that is one token, at which the ids are cut. Texts that hold a special token are encoded
    whole.
    """

    def __init__(self, path: str, end_id: int | None = 0, cap: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        symbols = [chr(c) for c in range(0xA1, 0x3000) if unicodedata.category(chr(c)) == "So"]
        self.mark = next(c for c in symbols if len(self.tokenizer.encode(c, add_special_tokens=False).ids) == 1)
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self.words = Cache(cap)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> None:
        """New words into the young generation."""
        mark = self.mark.encode()
        alone = [w for w in words if mark in w]
        if alone:
            self.words.young.update(zip(alone, self._ids([w.decode() for w in alone])))
            words = [w for w in words if mark not in w]
        between = b" " + mark + b" "
        for lo in range(0, len(words), JOINED * 50):
            lists = [words[i : i + JOINED] for i in range(lo, min(len(words), lo + JOINED * 50), JOINED)]
            for own, e in zip(lists, self.tokenizer.encode_batch_fast([between.join(x).decode() for x in lists], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
                self.words.young.update(zip(own, [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)])]))

    def _learn(self, words: set[bytes]) -> None:
        """Every given word gets into the young generation."""
        whole, tailed, stems = [], [], set()
        for w in self.words.missing(words):
            stem = w.rstrip(_TAIL)
            if len(stem) == len(w) or not self._cut_after(stem):
                whole.append(w)
            else:
                tailed.append((w, stem, w[len(stem):]))
                stems.add(stem)
        stems.difference_update(self.words.young)
        tails = {t for _, _, t in tailed}.difference(self.words.young)
        self._encode(list(stems.union(whole, tails)))
        young = self.words.young
        young.update([(w, young[a] + young[b]) for w, a, b in tailed])

    @staticmethod
    def _cut_after(stem: bytes) -> bool:
        """Whether the stem's last character is a letter to the tokenizer: a capital I with a dot, say, becomes an i and a mark."""
        if stem.isalpha() or stem[-1:].isalpha():  # ASCII
            return True
        return bool(stem) and stem[-1] > 127 and unicodedata.normalize("NFC", stem.decode()).lower()[-1].isalpha()

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id last; a null text is empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts)))
        words = split.values.dictionary_encode()
        # Each distinct word's ids once, then every word's ids from there.
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        self._learn(set(distinct))
        found = list(map(self.words.young.__getitem__, distinct))
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, code = np.cumsum(size) - size, words.indices.to_numpy()
        count = size[code]
        stops = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first[code] - stops[:-1], count) + np.arange(stops[-1])]
        edges = (4 * stops[split.offsets.to_numpy()]).tolist()
        raw, own = ids.tobytes(), iter(self._ids(pc.filter(texts, pa.array(whole)).to_pylist()))
        return [(next(own) if w else raw[lo:hi]) + self.end for w, lo, hi in zip(whole.tolist(), edges[:-1], edges[1:])]


class Cache:
    """Bytes of bytes, in two generations: when the young one is full, it becomes the old one, and what is used again moves back."""

    def __init__(self, cap: int):
        self.cap, self.young, self.old = cap, {}, {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Those of keys that are in neither generation; the others are in the young one after this."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.cap:
            self.old, self.young, new = self.young, {}, keys
        known = new.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known)))
        return list(new.difference(known))


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int | None = 0) -> WordEncoder:
    """One encoder per Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]
