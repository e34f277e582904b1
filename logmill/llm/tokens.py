"""Token ids of whole texts by the tokenizers library, with the work on repeated words saved.

A byte-level BPE cuts a text into pretokens and merges inside each, so a pretoken has the same ids
wherever it stands; the ids of each distinct pretoken are asked of the library once and kept per worker.
Texts with special tokens, or characters whose class may differ between Unicode versions, go to the library
whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import per_worker

_L1 = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_L = _L1 + "\u0100-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Outside of these, character classes are left to the library.
UNSAFE = re.compile(f"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xbf\xd7\xf7‐-‧‰-⁞€{_L}]")
SAFE_LATIN = bytes(b for b in range(256) if not UNSAFE.match(chr(b)))


#: How byte-level vocabularies spell a space.
SPACE = "\u0120"


def _pretokens(letters: str) -> re.Pattern:
    # words come first as most tokens are words; no other alternative matches where they do
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^\s{letters}{_N}]+|\s+(?!\S)|\s+")


PRETOKEN, PRETOKEN_LATIN = _pretokens(_L), _pretokens(_L1)


def cutter(text: str) -> re.Pattern | None:
    """What cuts the text into pretokens; None if it has characters outside of the known classes."""
    try:
        latin = text.encode("latin-1")
    except UnicodeEncodeError:
        return None if UNSAFE.search(text) else PRETOKEN
    return None if latin.translate(None, SAFE_LATIN) else PRETOKEN_LATIN


def is_byte_level(spec: dict) -> bool:
    """Whether the rules above hold for this tokenizer file."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    return (
        pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    )


def read_spec(path: str, most_mb: int = 64) -> str:
    """The tokenizer file as text, for a broadcast; refuses files beyond ``most_mb``."""
    with open(path, "rb") as f:
        blob = f.read((most_mb << 20) + 1)
    if len(blob) > most_mb << 20:
        raise ValueError(f"{path} is over {most_mb} MB")
    return blob.decode()


class Recent:
    """What was learnt for recent keys: of two generations of ``most`` entries the older one goes."""

    def __init__(self, learn, most: int):
        # plain dicts, from which a set is subtracted without a loop in Python
        self.learn, self.most, self.now, self.old = learn, most, {}, {}

    def want(self, keys: set):
        """Looks keys up, ``keys`` at least until the next call."""
        new = keys.difference(self.now)
        if new:
            if len(self.now) + len(new) > self.most:
                self.old, self.now, new = self.now, {}, keys
            ask = new.difference(self.old)
            if len(ask) < len(new):
                old = self.old
                self.now.update({k: old[k] for k in new - ask})
            if ask:
                asked = list(ask)
                self.now.update(zip(asked, self.learn(asked), strict=True))
        return self.now.__getitem__


class Encoder:
    """encode(texts): for each text its ids as little-endian bytes of ``dtype``."""

    def __init__(self, spec: str, most_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        parsed = json.loads(spec)
        self.cached = is_byte_level(parsed)
        self.specials = [t["content"] for t in parsed.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Recent(self._pretokens, most_pieces)
        #: The ids whose piece begins with a space, in the letter that stands for it.
        vocabulary = self.tok.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece[:1] == SPACE]] = True
        self.model = self.tok.model

    def _library(self, texts: list[str], step: int = 20_000) -> list[bytes]:
        kind, out = self.dtype.char, []
        for a in range(0, len(texts), step):
            out += [array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts[a : a + step], add_special_tokens=False)]
        return out

    def _pretokens(self, new: list[str], step: int = 1000) -> list[bytes]:
        """Ids of pretokens. Words of ASCII letters after a space are spelt alike in the vocabulary, so the library's model
        takes them as they are. Other words that begin with a space part again where they are joined, so the library
        gets many at a time; a word's first id, and no other of its ids, is a piece that begins with a space."""
        out: list[bytes | None] = [None] * len(new)
        size, kind, merge, words = self.dtype.itemsize, self.dtype.char, self.model.tokenize, []
        for i, p in enumerate(new):
            if p[0] == " " and p[1:].isalpha():
                if p.isascii():
                    out[i] = array(kind, [t.id for t in merge(SPACE + p[1:])]).tobytes()
                else:
                    words.append(i)
        for a in range(0, len(words), step):
            part = words[a : a + step]
            (found,) = self.tok.encode_batch_fast(["".join([new[i] for i in part])], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            starts = np.flatnonzero(self.begins[ids]) * size
            if len(starts) == len(part):
                flat = ids.tobytes()
                cuts = [*starts.tolist(), len(flat)]
                for i, b, e in zip(part, cuts, cuts[1:], strict=False):
                    out[i] = flat[b:e]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([new[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.cached:
            cut = {i: c.findall(t) for i, t in enumerate(texts) if not any(s in t for s in self.specials) and (c := cutter(t))}
            ids = self.known.want(set().union(*cut.values()))
            for i, c in cut.items():
                out[i] = b"".join(map(ids, c))
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, found in zip(rest, self._library([texts[i] for i in rest]), strict=True):
                out[i] = found
        return out


def encoder_of(spec: str) -> Encoder:
    """This worker's encoder for the tokenizer file."""
    return per_worker(("encoder", hash(spec)), lambda: Encoder(spec))


def blocks(texts: list[str], most_chars: int = 2_000_000):
    """Index ranges of about ``most_chars`` characters, so that what is held at once is bounded."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
