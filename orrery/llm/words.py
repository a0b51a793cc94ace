"""Distinct-unit memo: a unit (pre-token run) is tokenised once and then looked up."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units a worker holds, and their bytes, before it starts afresh.
MEMO_UNITS = 700_000
MEMO_BYTES = 24 << 20


def load_tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library, single-threaded."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Fixed value: how byte-level BPE of this kind cuts pre-tokens.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def ranked(path: str):
    """The same byte-level BPE as ranks of byte strings, which merges several times faster.

    None unless the file's merges are in the order of their ids and it cuts in the usual way.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("end_of_word_suffix")
    if not usual or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    import tiktoken

    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Grown:
    """A numpy array that grows at its end without being copied whole each time."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        stop = self.n + len(more)
        if stop > len(self.held):
            wider = np.empty(max(stop, 2 * len(self.held)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : stop] = more
        self.n = stop

    def view(self) -> np.ndarray:
        return self.held[: self.n]


class Memo:
    """unit -> row of (count, first id's place, sentence end) for the units met so far, and their ids.

    Bounded by units and by bytes: a chunk that finds it full starts it afresh, so it
    never holds more than the bounds and one chunk.
    """

    def __init__(self, path: str, most: int = MEMO_UNITS, most_bytes: int = MEMO_BYTES):
        self.path, self.ranked, self.most, self.most_bytes = path, ranked(path), most, most_bytes
        self.clear()

    @functools.cached_property
    def tok(self):
        """The library's tokenizer, for what the ranks don't say: special strings, or all where there are none."""
        return load_tokenizer(self.path)

    def clear(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.held = 0
        self.count, self.first, self.ends, self.pool = Grown(np.int64), Grown(np.int64), Grown(bool), Grown(np.int32)
        for x in (self.count, self.first, self.ends):
            x.extend(np.zeros(1, x.held.dtype))

    def learn(self, units: list[str]) -> None:
        """Tokenises those of the distinct ``units`` (of byte_bpe_cut) that were not met before."""
        if len(self.row) + len(units) > self.most or self.held > self.most_bytes:
            self.clear()
        new = [u for u in units if u not in self.row]
        self.held += sum(map(len, new))
        if self.ranked:
            plain = [u for u in new if not u[-1].isspace() and "<|" not in u]
            for at in range(0, len(plain), 512 * 64):
                self.learn_plain(plain[at : at + 512 * 64])
            spaces = [u for u in new if u[-1].isspace() and "<|" not in u]
            ids = [self.ranked.encode_ordinary(u) for u in spaces]
            self.keep(spaces, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.int32))
            new = [u for u in new if u not in self.row]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            self.keep(part, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.int32))

    def learn_plain(self, units: list[str]) -> None:
        """Units that hold no white space but one leading space, many to a text: a line end between two is a token of its own."""
        mark = self.ranked.encode_ordinary("\n")[0]
        texts = ["\n".join([*units[i : i + 512], ""]) for i in range(0, len(units), 512)]
        ids = np.concatenate([np.array(self.ranked.encode_ordinary(t), np.int32) for t in texts])
        marks = np.flatnonzero(ids == mark)
        self.keep(units, np.diff(np.concatenate([[-1], marks])) - 1, ids[ids != mark])

    def keep(self, units: list[str], count: np.ndarray, ids: np.ndarray) -> None:
        self.row.update(zip(units, range(self.count.n, self.count.n + len(units)), strict=True))
        self.first.extend(self.pool.n + np.cumsum(count) - count)
        self.count.extend(count)
        self.ends.extend(np.fromiter((u == "\n" or u[-1:] in ".!?" for u in units), bool, len(units)))
        self.pool.extend(ids)

    def rows(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts, first place in the pool, sentence-end flags and pooled ids, by row."""
        return self.count.view(), self.first.view(), self.ends.view(), self.pool.view()


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    """The worker's memo for a tokenizer; workers outlive tasks, so units stay known."""
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


#: Unicode white space besides the space and the line end, as part of a character class.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spacing after which pre-tokens don't simply end before every space and around every line end.
ODD = f"[\\x00{OTHER_SPACE}]|\n\n\n|\n\n\\z|  | \n|\n | \\z|<\\|"
#: White space and a word that may hold a special string, which ends the white space before it.
SPECIAL_UNIT = f"[ \n{OTHER_SPACE}]*(?=[^ \n{OTHER_SPACE}]*<\\|)[^ \n{OTHER_SPACE}]+|"
#: The units of such a text: a word with one space before it; white space up to its last sign; the rest.
ODD_UNITS = f" ?[^ \n{OTHER_SPACE}]+|[ \n{OTHER_SPACE}]+(?=[ \n{OTHER_SPACE}][^ \n{OTHER_SPACE}])|[ \n{OTHER_SPACE}]+\\Z|[ \n{OTHER_SPACE}]"
ODD_UNITS, ODD_UNITS_SPECIAL = re.compile(ODD_UNITS), re.compile(SPECIAL_UNIT + ODD_UNITS)


def byte_bpe_cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of the texts in order, cut where byte-level BPE pre-tokens always end, and units per text.

    Empty units may stand among them. Any spacing is cut, so no unit is longer than a word or a run of white space.
    """
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    signs = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), " ", "\x00 "), "\n", "\x00\n\x00")
    lists = pc.split_pattern(signs, "\x00")
    flat, per = lists.flatten(), np.zeros(len(texts), np.int64)
    per[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if not odd.any():
        return flat, per
    others = [(ODD_UNITS_SPECIAL if "<|" in t else ODD_UNITS).findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    per[odd] = [len(u) for u in others]
    both = pa.concat_arrays([flat, pa.array([u for us in others for u in us], flat.type)])
    begin = np.zeros(len(texts), np.int64)
    for which, base in ((~odd, 0), (odd, len(flat))):
        begin[which] = base + np.cumsum(per[which]) - per[which]
    return both.take(pa.array(ragged(begin, per))), per


def byte_bpe_units(text: str) -> list[str]:
    """The units of one text, without empty ones."""
    return [u for u in byte_bpe_cut(pa.array([text], pa.string()))[0].to_pylist() if u]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + count[i] - 1 of all i, in order."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - count - first, count)
