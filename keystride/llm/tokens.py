"""Token ids of texts with the public tokenizers, by pieces that are encoded once per worker.

Byte-level and word-end BPE encode a text piece by piece, and no piece of theirs crosses an ASCII
space that stands alone (the space itself opens the next piece in the byte-level form). So texts
are cut at those spaces, each distinct piece is encoded by the tokenizers library and kept in a
bounded table, and a text's ids are its pieces' ids in a row, gathered for a whole batch at once.
Texts with two spaces in a row are encoded as one piece. Unknown pieces that are words are encoded many
to a call, which costs less than half of a call's share for each; the ids tell where each ends.
"""

import os
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: About 100 MB of a worker's memory.
KEPT_PIECES = 400_000
#: Unknown words that are one text for the tokenizer.
ROW_WORDS = 500
END = 1
ENDS = {" ": " ", "\x00": r"\x00"}  # a separator as a pattern
#: ASCII and Latin letters, but not the one (U+0130) that is a letter and a mark when lower-cased.
LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ſ]"
SIGNS = r"[!-/:-@\[-`{-~]+"


class PieceEncoder:
    """Ids of batches of texts. `space_opens`: a space belongs to the piece that follows it.
    `lower`: the tokenizer lower-cases, so that a lower-cased piece has the same ids."""

    def __init__(self, path: str, space_opens: bool, lower: bool = False, kept: int = KEPT_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.space_opens, self.lower, self.kept = space_opens, lower, kept
        self.pieces: dict[str, bytes] = {}
        self.mark = self._mark() if space_opens else None
        self.word_ends = None if space_opens else self._word_ends()

    def _mark(self) -> int | None:
        """The id of \x00, if no other token has that byte: what stands around it is then encoded by itself."""
        ids, tokens = self.tokenizer.encode("\x00", add_special_tokens=False), self.tokenizer.get_vocab()
        if len(ids.ids) != 1 or sum(ids.tokens[0] in token for token in tokens) != 1:
            return None
        return ids.ids[0]

    def _word_ends(self) -> np.ndarray | None:
        """Whether each id ends a word, if the tokenizer says so."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        tokens = self.tokenizer.get_vocab()
        ends = np.zeros(max(tokens.values()) + 1, bool)
        ends[[i for token, i in tokens.items() if token.endswith(suffix)]] = True
        return ends

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 20_000):
            some = pieces[i:i + 20_000]
            if self.mark is not None:
                # Words in a row, with a mark after each, are one call; what the mark could change goes alone: spaces
                # before it, and signs without a space after it.
                words = [(p[:1] == " " or p[:1].isalnum()) and not p[-1:].isspace() and "\x00" not in p for p in some]
                together = self._in_a_row
            elif self.word_ends is not None:
                # Letters alone are one word, with spaces between them too; they cannot spell the suffix.
                words, together = [p.isalpha() for p in some], self._words
            else:
                out += self._each(some)
                continue
            alone = iter(self._each([p for p, w in zip(some, words) if not w]))
            row = iter(together([p for p, w in zip(some, words) if w]))
            out += [next(row) if w else next(alone) for w in words]
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _in_a_row(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        (found,) = self.tokenizer.encode_batch_fast(["\x00".join(pieces) + "\x00"], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(pieces):
            raise RuntimeError("a mark was lost")
        data, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
        return [data[4 * s:4 * e] for s, e in zip(starts.tolist(), ends.tolist())]

    def _words(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        rows = [" ".join(pieces[i:i + ROW_WORDS]) for i in range(0, len(pieces), ROW_WORDS)]
        found = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        if len(ends) != len(pieces):  # some are more than one word: a letter of Python's that is none of the tokenizer's
            return self._each(pieces)
        data, starts = ids.tobytes(), np.concatenate([[0], ends[:-1]])
        return [data[4 * s:4 * e] for s, e in zip(starts.tolist(), ends.tolist())]

    def _known(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.pieces.get, pieces))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            new = [pieces[i] for i in missing]
            known = self._ids(new)
            for i, ids in zip(missing, known):
                found[i] = ids
            # A full table stays while it knows most pieces: what came first is what comes often.
            if len(self.pieces) + len(new) > self.kept and 2 * len(new) > len(pieces):
                self.pieces.clear()
            if len(self.pieces) + len(new) <= self.kept:
                self.pieces.update(zip(new, known))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids end."""
        if self.lower:
            # Lower-casing depends on the neighbours of a capital sigma alone, and gives another order of marks
            # after a dotted capital I alone, whose dot becomes one.
            texts = [
                t.lower() if t.isascii() or ("Σ" not in t and "İ" not in t and unicodedata.is_normalized("NFC", t)) else t
                for t in texts
            ]
        if self.space_opens:
            # A mark before each space, which then stays with what follows; \x00 marks nothing else.
            odd = [("  " in t or "\x00" in t) for t in texts]
            cut = [t if o else t.replace(" ", "\x00 ") for t, o in zip(texts, odd)]
            mark = "\x00"
        else:
            odd = ["  " in t for t in texts]
            cut = [t if o else t.replace("\n", " ") for t, o in zip(texts, odd)]
            mark = " "
        # A text of two spaces is one piece: the pieces of the others are found together.
        plain = pa.array([None if o else t for t, o in zip(cut, odd)], pa.large_string())
        # Signs between a letter and a space are a piece of their own in either form, and without
        # them the word before is one piece wherever it stands.
        plain = pc.replace_substring_regex(plain, rf"({LETTER})({SIGNS})({ENDS[mark]}|$)", rf"\1{mark}\2\3")
        plain = pc.split_pattern(plain, mark)
        flat = plain.flatten().dictionary_encode()
        # By numpy: to_pylist takes several times as long for many short strings.
        table = self._known(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        table += self._known([t for t, o in zip(texts, odd) if o])
        codes = flat.indices.to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(plain).fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
        if any(odd):
            at = np.cumsum(counts) - counts
            whole = np.nonzero(odd)[0]
            codes = np.insert(codes, at[whole] - np.arange(len(whole)), len(flat.dictionary) + np.arange(len(whole)))
        ids = np.frombuffer(b"".join(table), dtype="<u4")
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(ids)) < 2**31 else np.int64
        take = np.repeat((starts[codes] - (ends - n)).astype(kind), n)
        take += np.arange(total, dtype=kind)
        last = np.cumsum(counts)
        return ids[take], np.concatenate([[0], ends])[last]


def worker_encoder(path: str, space_opens: bool, lower: bool) -> PieceEncoder:
    """One encoder for each worker process; its table outlives a task.

    Task functions are pickled with their modules' names, so what must stay between tasks hangs on
    a module that they cannot replace. A task has one core: threads of the tokenizers library cost
    more than they gain there."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = vars(sys).setdefault("_keystride_encoders", {})
    key = path, space_opens, lower
    if key not in kept:
        kept[key] = PieceEncoder(*key)
    return kept[key]


def slices(lengths: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of at most `most` characters, or single texts."""
    out, first, held = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(lengths))] if lengths else []


def documents_ids(encoder: PieceEncoder, texts: pa.Array):
    """For each text its ids with the end id, as an array of 32-bit numbers; null is empty.

    Only a run of texts at a time is made into Python strings."""
    texts = texts.fill_null("")
    for first, end in slices(pc.utf8_length(texts).to_pylist()):
        ids, ends = encoder.encode(texts[first:end].to_pylist())
        start = 0
        for stop in ends.tolist():
            yield np.append(ids[start:stop], np.uint32(END))
            start = stop
