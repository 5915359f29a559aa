"""Encoding of whole texts through their distinct words.

A pre-tokenizer that never lets a token cross certain places (white space; a letter followed by a
point or comma) allows each stretch between such places to be encoded once and looked up after
that. The ids are those of encoding the whole text; only the work is shared between equal words.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from cargoscope.llm.batches import give_back, kept_in_worker, ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words a worker remembers before it drops those it has met once; bounds its memory, not the result.
MAX_WORDS = 600_000
#: Words encoded in one call: the library keeps each token's text and places until the call ends.
JOINT_WORDS = 10_000

#: Marks cuts inside a text; texts that hold it themselves are encoded as they stand.
_CUT = "\x01"
_LETTER_TAIL = "([A-Za-z])([.,;:!?])"
_LINE_BREAK = "([.,;:!?])\n([A-Za-z])"

#: Pre-tokenizers that leave a word of letters whole, and normalizers that leave lower-case ones of Latin 1 alone.
_LETTERS_WHOLE = (
    r" ?\p{L}+",  # the library's own pattern, where a file says only that it is used
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
_LETTERS_KEPT = ("NFC", "Lowercase", "Replace")
_LOWER_WORD, _WORD = re.compile("[a-zß-öø-ÿ]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Token ids of texts for a tokenizer file.

    ``keeps_space`` says which of the two pre-tokenizers the file has: one that drops white space
    and lower-cases, or one whose words carry the single space before them. A control string of the
    file inside a text becomes its id, as in a plain call of the tokenizer; ``control_ids=False`` reads
    it as text.
    """

    def __init__(self, path: str, keeps_space: bool, control_ids: bool = True):
        # Spark runs a worker per core: the library's own threads would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control_ids
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.controls = [t.content for t in added if t.special] if control_ids else []
        self.keeps_space = keeps_space
        self.plain, self.plain_word = self._for_letters(path, keeps_space)
        # A control string that leaves what stands beside it alone can part words in a joint call.
        plain = [t for t in added if t.special and control_ids and not (t.lstrip or t.rstrip or t.single_word)]
        self.parting = plain[0].content if plain else None
        self.parting_id = self.tokenizer.token_to_id(self.parting) if plain else None
        self.words = MAX_WORDS
        self._forget()

    def _for_letters(self, path: str, keeps_space: bool):
        """A tokenizer for words of letters, and those words' pattern; None if the file's steps are not known.

        It has the file's model only: normalizing such a word and looking for pieces in it changes nothing,
        yet takes longer than its merges.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        whole = self.tokenizer
        normal, pre = (x and json.loads(x.__getstate__()) for x in (whole.normalizer, whole.pre_tokenizer))
        pre = pre or {}
        changes = [] if normal is None else normal.get("normalizers", [normal])
        splits = pre.get("pretokenizers", [pre])
        pattern = splits[0].get("pattern", {}).get("Regex") if splits[0].get("type") == "Split" else None
        level = splits[-1]
        if level.get("use_regex") and len(splits) == 1:
            pattern = _LETTERS_WHOLE[0]
        blanks = all(c["type"] != "Replace" or c.get("pattern") == {"Regex": r"\s+"} for c in changes)
        known = pattern in _LETTERS_WHOLE and level.get("type") == "ByteLevel" and not level.get("add_prefix_space")
        known = known and len(splits) <= 2 and blanks and all(c["type"] in _LETTERS_KEPT for c in changes)
        if not known or keeps_space == bool(changes):
            return None, None
        # Both share one model in memory, where the file's pieces keep their ids that way.
        bare, added = Tokenizer(whole.model), whole.get_added_tokens_decoder()
        bare.add_tokens([t for _, t in sorted(added.items())])
        if {i: repr(t) for i, t in bare.get_added_tokens_decoder().items()} != {i: repr(t) for i, t in added.items()}:
            bare = Tokenizer.from_file(path)
        bare.encode_special_tokens = whole.encode_special_tokens
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return bare, _WORD if keeps_space else _LOWER_WORD

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        # All words' ids one after the other, and where each word's begin (one more at the end).
        self.flat, self.start = array("I"), array("q", [0])
        # Whether a word was met in a later call than its first.
        self.again = bytearray()
        # Whether a word ends, and whether it begins, so that white space beside it may join it.
        self.ends, self.begins = bytearray(), bytearray()

    def _thin(self) -> None:
        """Only words that were met again stay; all go if those are many."""
        keep = np.flatnonzero(np.frombuffer(self.again, np.uint8))
        if len(keep) > self.words * 3 // 4:
            return self._forget()
        words = list(compress(self.slot, self.again))
        start, flat = np.array(self.start, np.int64), np.array(self.flat, np.uint32)
        ends, begins = self.ends, self.begins
        self._forget()
        counts = np.diff(start)[keep]
        self.slot = dict(zip(words, range(len(words)), strict=True))
        self.flat.frombytes(flat[ranges(start[keep], counts)].tobytes())
        self.start.frombytes(np.cumsum(counts, dtype=np.int64).tobytes())
        self.again = bytearray(len(words))
        if self.keeps_space:
            self.ends, self.begins = (bytearray(np.frombuffer(x, np.uint8)[keep].tobytes()) for x in (ends, begins))

    def _encoded(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has.

        Words go through the tokenizer in one text, parted by a control string: a call per word costs
        several times what its ids do. Where that cannot be told apart, words go one by one.
        """
        if self.parting is not None:
            joint = tokenizer.encode_batch_fast([self.parting.join(words)], add_special_tokens=False)[0]
            ids = np.array(joint.ids, np.uint32)
            parting = ids == self.parting_id
            at = np.flatnonzero(parting)
            if len(at) == len(words) - 1:
                return ids[~parting], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        each = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def rest(self) -> None:
        """At the end of a task: a worker that waits for its next one keeps only words met again."""
        self._thin()
        give_back()

    def _slots(self, words: list[str]) -> np.ndarray:
        """The words' slots; new words are encoded and get one."""
        known = len(self.slot)
        new = list(dict.fromkeys([w for w in words if w not in self.slot]))
        if self.plain is None:
            kinds = [(self.tokenizer, new)]
        else:
            letters = [w for w in new if self.plain_word.fullmatch(w)]
            others = [w for w in new if not self.plain_word.fullmatch(w)]
            kinds = [(self.plain, letters), (self.tokenizer, others)]
        for tokenizer, own in kinds:
            for first in range(0, len(own), JOINT_WORDS):
                part = own[first : first + JOINT_WORDS]
                ids, counts = self._encoded(tokenizer, part)
                self.slot.update(zip(part, range(len(self.slot), len(self.slot) + len(part)), strict=True))
                self.start.frombytes((np.cumsum(counts, dtype=np.int64) + len(self.flat)).tobytes())
                self.flat.frombytes(ids.tobytes())
                if self.keeps_space:
                    self.ends += bytes([p[-1:].isspace() for p in part])
                    self.begins += bytes([p == " " or p[:2].isspace() for p in part])
        self.again += bytes(len(new))
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        np.frombuffer(self.again, np.uint8)[slots[slots < known]] = 1
        return slots

    def _dropping(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _LETTER_TAIL, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        words = pc.if_else(pc.string_is_ascii(coded.dictionary), pc.ascii_lower(coded.dictionary), coded.dictionary)
        slots = self._slots(words.to_pylist())
        return slots[coded.indices.to_numpy()], lists.offsets.to_numpy().astype(np.int64)

    def _keeping(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(texts, _LETTER_TAIL, rf"\1{_CUT}\2")
        cut = pc.replace_substring_regex(cut, _LINE_BREAK, f"\\1{_CUT}\n{_CUT}\\2")
        cut = pc.replace_substring(cut, " ", f"{_CUT} ")
        whole = pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(cut, _CUT)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        known, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        slots = self._slots(known)[at]
        # Where white space meets white space, a token may cross: those texts are joined up again.
        meet = np.zeros(len(at) + 1, bool)
        meet[1:-1] = np.frombuffer(self.ends, bool)[slots[:-1]] & np.frombuffer(self.begins, bool)[slots[1:]]
        meet[offsets[:-1]] = False
        odd = whole.copy()
        odd[np.searchsorted(offsets, np.flatnonzero(meet), side="right") - 1] = True
        if not odd.any():
            return slots, offsets
        parts, counts = [], np.diff(offsets)
        for i in range(len(texts)):
            if odd[i]:
                words = [texts[i].as_py()] if whole[i] else []
                for k in range(offsets[i], offsets[i + 1] if not whole[i] else offsets[i]):
                    if meet[k]:
                        words[-1] += known[at[k]]
                    else:
                        words.append(known[at[k]])
                self._slots(list(dict.fromkeys(words)))
                parts.append(self._slots(words))
                counts[i] = len(words)
            else:
                parts.append(slots[offsets[i] : offsets[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _controlled(self, texts: pa.Array) -> np.ndarray:
        """Places of texts with a control string in any case: lower-casing words must not make one."""
        found = np.zeros(len(texts), bool)
        for control in self.controls:
            found |= pc.match_substring(texts, control, ignore_case=True).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def _spliced(self, texts: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all texts; those at ``at`` are encoded as they stand."""
        own = [texts[int(i)].as_py() for i in at]
        others = np.ones(len(texts), bool)
        others[at] = False
        slots, offsets = self._cut(pc.if_else(pa.array(others), texts, ""))
        self._slots(list(dict.fromkeys(own)))
        parts, last = [], 0
        for i, slot in zip(at, self._slots(own), strict=True):
            parts += [slots[last : offsets[i]], [slot]]
            last = offsets[i + 1]
        counts = np.diff(offsets)
        counts[at] = 1
        joined = np.concatenate([*parts, slots[last:]]).astype(np.int64)
        return joined, np.concatenate([[0], np.cumsum(counts)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return (self._keeping if self.keeps_space else self._dropping)(texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (one more at the end)."""
        if len(self.slot) > self.words:
            self._thin()
        texts = pc.fill_null(texts, "")
        at = self._controlled(texts)
        slots, offsets = self._spliced(texts, at) if len(at) else self._cut(texts)
        start = np.frombuffer(self.start, np.int64)
        first = start[slots]
        counts = start[slots + 1] - first
        ids = np.frombuffer(self.flat, np.uint32)[ranges(first, counts)] if len(slots) else np.zeros(0, np.uint32)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[offsets]


def encoder(path: str, keeps_space: bool, control_ids: bool = True, words: int = MAX_WORDS) -> WordEncoder:
    """The worker's encoder for a tokenizer file, which remembers about ``words`` words from now on."""
    name = f"encoder:{path}:{keeps_space}:{control_ids}"
    own = kept_in_worker(name, lambda: WordEncoder(path, keeps_space, control_ids))
    own.words = words
    return own


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after every text."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = ids, end_id
    return out, offsets + np.arange(n + 1)
