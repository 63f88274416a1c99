"""Sampled SentencePiece segmentations: Gumbel top-k without replacement over the lattice.

The lattice of a text has an edge for every vocabulary piece at every place, and one for the bytes
of a character that no piece holds. Edge weights give every segmentation a probability; with the
log-sums to the right of each place, the probability of a next edge given the place is known. The
search keeps partial segmentations in a frontier, each with the largest Gumbel-perturbed log
probability below it, and always goes on with the best: it walks to its end, where the largest
value passes to one child and the others get values conditioned to lie below. The first k ends are
a sample of k distinct segmentations without replacement, in order of their perturbed values. The
inclusion score of one is the chance that its value exceeds the k+1-st, 1 - exp(-exp(log p - kappa)).

Pieces never hold a space sign behind another character, so texts fall into space-led words whose
lattices are built once for equal words and kept by the worker, and all documents of a batch take their
next step together; once few words are under way, the edges of all their places are chosen at once. Noise is a hash of the row key, the round, the word, the place and the edge, so a
row's samples do not depend on its partition.

Piece probabilities follow Zipf's law in the model's merge order; the model has no others.

Edge cases: null and empty texts have one segmentation without pieces, of probability 1; texts with
fewer than k segmentations give all of them, with inclusion 1; equal rows give equal samples; a
null key counts as its own key. The space sign U+2581 in a text decodes to a space, as in the
library. Only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import kept, mixed, text_bytes
from .token_counts import space_words

#: Characters of text whose new words get their lattices at once, and of text that is searched together.
GROUP_CHARS, BATCH_CHARS = 1 << 20, 1 << 18
#: Characters of words whose lattices a worker keeps for its next texts, some 40 bytes each.
KEPT_CHARS = 1 << 21
#: With fewer words under way, all their places are sampled at once.
FEW = 256
#: Offset of Zipf's law, log-odds of a byte piece.
ZIPF, BYTE_WEIGHT = 10.0, 1e-6
_U64 = np.uint64
_SPACE = "▁"
_M = _U64(0x9E3779B97F4A7C15 | 1)
_SLOT = _U64(0xD1342543DE82EF95)
#: Salts of the characters left in a word and of an edge's number at its place.
_LEFT, _EDGE = _U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F)


class _Hashes:
    """Sorted hashes with their values, and slots by which most are found at once."""

    def __init__(self, table: dict[int, int]):
        self.hashes = np.asarray(sorted(table), _U64)
        self.values = np.asarray([table[h] for h in self.hashes.tolist()], np.int64)
        bits = (8 * len(table)).bit_length()
        self.shift = _U64(64 - bits)
        slot = self._slot(self.hashes)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.flatnonzero(np.bincount(slot) > 1)] = -1  # shared ones: to be searched for

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SLOT) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``h`` holds known hashes, and their values."""
        at = self.slots[self._slot(h)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.hashes, h[shared]), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        return hit, self.values[at[hit]]


class Vocabulary:
    """Pieces with log probabilities, and hashes of pieces and of their prefixes by length."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(_SPACE in self.pieces[i].lstrip(_SPACE) for i in normal):
            raise ValueError("a piece holds a space sign behind another character")
        order = sorted(normal, key=lambda i: (-m.get_score(i), i))
        weight = 1.0 / (np.arange(len(order)) + ZIPF)
        weight /= weight.sum()
        log_p = np.full(n, np.log(BYTE_WEIGHT))
        log_p[order] = np.log(weight)
        self.log_p = log_p
        self.bytes = np.zeros(256, np.int64)
        self.raw = [p.replace(_SPACE, " ").encode() for p in self.pieces]
        for i in range(n):
            if m.is_byte(i):
                value = int(self.pieces[i][3:-1], 16)
                self.bytes[value] = i
                self.raw[i] = bytes([value])
        self.spelled = pa.array(self.raw, pa.large_binary())
        self.forget()
        self.longest = max(len(self.pieces[i]) for i in normal)
        # Per length the sorted hashes of all beginnings of pieces, and the piece that one is, or -1.
        known: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        for i in normal:
            h = 0
            for length, c in enumerate(self.pieces[i], 1):
                h = (h * int(_M) + ord(c) + 1) & (1 << 64) - 1
                known[length].setdefault(h, -1)
            known[len(self.pieces[i])][h] = i
        self.known = [_Hashes(table) for table in known[1:]]

    def forget(self) -> None:
        """Words with lattices, and their lattices."""
        self.numbers, self.lattice = _Numbers(), None

    def lattice_of(self, numbers: dict[str, int]) -> Lattice:
        """The lattice of all ``numbers``, whose last words may be new to it."""
        known = 0 if self.lattice is None else len(self.lattice.size)
        if known < len(numbers) or self.lattice is None:
            signed = [
                _SPACE + u if " " not in u and u[:1] != "\0"
                else (u[1:] if u[:1] == "\0" and u.strip("\0 ") == "" and len(u) > 1 else " " + u).replace(" ", _SPACE)
                for u in islice(numbers, known, None)
            ]
            new = Lattice(signed, self)
            self.lattice = new if self.lattice is None else self.lattice.followed_by(new)
        return self.lattice

    def ids_of(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with the bytes of characters in place of -1 - character, and where the former ``ends`` are."""
        spelled = np.flatnonzero(pieces < 0)
        if not len(spelled):
            return pieces, ends
        signs, which = np.unique(-1 - pieces[spelled], return_inverse=True)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in signs.tolist()]
        size = np.asarray([len(r) for r in raw])
        n = np.ones(len(pieces), np.int64)
        n[spelled] = size[which]
        after = np.append(0, np.cumsum(n))
        ids = np.repeat(pieces, n)
        at = _expand(after[spelled], n[spelled])
        ids[at] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)[_expand((np.cumsum(size) - size)[which], n[spelled])]]
        return ids, after[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the space before the first taken off."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Lattice:
    """Edges of words and, from every place, the log chance of each next edge."""

    def __init__(self, words: list[str], v: Vocabulary):
        self.size = np.asarray([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.first = np.cumsum(self.size) - self.size
        place = np.arange(len(chars))
        left = np.repeat(self.first + self.size, self.size) - place
        starts, lengths, pieces = [], [], []
        alive, h, room, code = place, np.zeros(len(chars), _U64), left, chars.astype(_U64) + _U64(1)
        for n in range(1, v.longest + 1):
            fits = np.flatnonzero(room >= n)
            alive, h, room = alive[fits], h[fits], room[fits]
            if not len(alive):
                break
            h = h * _M + code[alive + (n - 1)]
            begins, piece = v.known[n - 1].find(h)
            alive, h, room = alive[begins], h[begins], room[begins]
            whole = piece >= 0
            starts.append(alive[whole])
            lengths.append(np.full(len(starts[-1]), n))
            pieces.append(piece[whole])
        single = np.zeros(len(chars), bool)
        if starts:
            single[starts[0]] = True
        rest = np.flatnonzero(~single)  # characters without a piece of their own: their bytes
        starts.append(rest)
        lengths.append(np.ones(len(rest), np.int64))
        pieces.append(-1 - chars[rest].astype(np.int64))
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        by = np.argsort(start, kind="stable")  # a merge of sorted runs
        self.length, self.piece, start = length[by], piece[by], start[by]
        weight = v.log_p[np.maximum(self.piece, 0)]
        spelled = np.flatnonzero(self.piece < 0)
        sign = -1 - self.piece[spelled]
        weight[spelled] = (1 + (sign >= 0x80).astype(int) + (sign >= 0x800) + (sign >= 0x10000)) * np.log(BYTE_WEIGHT)
        self.edges = np.append(0, np.cumsum(np.bincount(start, minlength=len(chars))))
        self.most = v.longest
        self.spare = (self.most - np.diff(self.edges)).astype(np.min_scalar_type(self.most))  # sorts places with more edges first
        # Log-sums to the right, from the words' ends to their fronts; the last one stands for all ends.
        ahead = np.zeros(len(chars) + 1)
        own_left = left[start]
        target = start + self.length
        target[self.length == own_left] = len(chars)
        small = own_left.astype(np.uint16) if int(own_left.max(initial=0)) < 1 << 16 else own_left
        order = np.argsort(small, kind="stable")
        cuts = np.cumsum(np.bincount(own_left)).tolist()
        from_place, to_place, ordered = start[order], target[order], weight[order]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            at = from_place[a:b]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ahead[at[new]] = np.logaddexp.reduceat(ordered[a:b] + ahead[to_place[a:b]], new)
        self.chance = weight + ahead[target] - ahead[start]
        self.length, self.piece, self.left = self.length.astype(np.int16), self.piece.astype(np.int32), left.astype(np.int32)

    def followed_by(self, other: Lattice) -> Lattice:
        """The lattice of the words of both, of this one first."""
        both = Lattice.__new__(Lattice)
        both.most = self.most
        for name in ("size", "length", "piece", "left", "chance", "spare"):
            setattr(both, name, np.append(getattr(self, name), getattr(other, name)))
        both.first = np.append(self.first, other.first + len(self.left))
        both.edges = np.append(self.edges[:-1], other.edges + len(self.length))
        return both


def _hashed(*parts: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    h = np.zeros(len(parts[0]), _U64) if start is None else start
    for part in parts:
        h = mixed(h + np.asarray(part).astype(_U64) + _U64(0x632BE59BD9B4E019))
    return h


def _noise(h: np.ndarray) -> np.ndarray:
    """Gumbel noise from hashes."""
    noise = (h >> _U64(11)).astype(np.float64)
    noise += 0.5
    noise *= 2.0**-53
    for _ in range(2):
        np.negative(np.log(noise, out=noise), out=noise)
    return noise


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Search:
    """The perturbed search over some documents at once."""

    def __init__(self, word: np.ndarray, counts: np.ndarray, keys: np.ndarray, lattice: Lattice, k: int):
        self.lattice, self.word, self.counts, self.keys, self.k = lattice, word, counts, keys, k
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.last = np.cumsum(counts)  # the words of a document end here
        self.place_in_doc = np.arange(len(word)) - np.repeat(self.last - counts, counts)
        # Open entries: document, value, parent round, word, step, place, edge.
        self.frontier = (np.empty(0, np.int64), np.empty(0), *(np.empty(0, np.int64) for _ in range(5)))
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []  # per round: edges; the first of each word

    def _seed(self, words: np.ndarray, turn: int) -> np.ndarray:
        own = _hashed(self.keys, np.full(len(self.keys), turn))
        return _hashed(self.place_in_doc[words], start=own[self.doc[words]])

    def _perturbed(self, seed: np.ndarray, places: np.ndarray, left: np.ndarray, first: np.ndarray, leaving: list[int]):
        """Edges of ``places`` and their perturbed log chances: the first ones, then the second ones, and so on.

        ``leaving`` has the number of places with such an edge; places with more edges come first.
        """
        own = left.astype(_U64)
        own *= _LEFT
        own += seed
        ends = np.cumsum(leaving).tolist()
        edge, salt = np.empty(ends[-1], np.int64), np.empty(ends[-1], _U64)
        for j, (m, b) in enumerate(zip(leaving, ends, strict=True)):
            np.add(first[:m], j, out=edge[b - m : b])
            np.add(own[:m], _U64(j * int(_EDGE) & (1 << 64) - 1), out=salt[b - m : b])  # salted with the edge's number at its place
        value = _noise(mixed(salt))
        value += self.lattice.chance[edge]
        return edge, value, ends

    def _choose(self, seed: np.ndarray, places: np.ndarray, left: np.ndarray, spare: np.ndarray):
        """The sampled edges of places in order of ``spare``; the best and second values of those with a choice, which come first."""
        lattice = self.lattice
        # Those with a j-th edge are a prefix.
        leaving = (len(places) - np.cumsum(np.bincount(spare, minlength=lattice.most + 1)[-2::-1])).tolist()
        m = leaving[0]
        first = lattice.edges[places]
        if not m:
            return first, np.empty(0), np.empty(0)
        leaving = [m, *(x for x in leaving if x)]
        _, value, ends = self._perturbed(seed[:m], places[:m], left[:m], first[:m], leaving)
        best, other = value[:m], value[m : 2 * m]
        number = (other > best).astype(np.int64)
        best, second = np.maximum(best, other), np.minimum(best, other)
        for j, (x, b) in enumerate(zip(leaving[2:], ends[2:], strict=True), 2):
            new, top = value[b - x : b], best[:x]
            np.copyto(number[:x], j, where=new > top)
            np.maximum(second[:x], np.minimum(new, top), out=second[:x])
            np.maximum(new, top, out=top)
        first[:m] += number
        return first, best, second

    def _walk(self, words: np.ndarray, places: np.ndarray, turn: int):
        """Sample from ``places`` to the words' ends.

        The number of steps of each word; words, steps and edges in parts; word, step, place, edge, its value and the next
        best value of those with a choice.
        """
        lattice, chosen, choices = self.lattice, [], []
        steps = np.zeros(len(self.word), np.int64)
        spare = lattice.spare[places]
        order = np.argsort(spare, kind="stable")
        words, places, spare = words[order], places[order], spare[order]
        seed, left = self._seed(words, turn), lattice.left[places]
        while len(words) >= FEW:
            picked, best, second = self._choose(seed, places, left, spare)
            m, step = len(best), len(chosen)
            choices.append((words[:m], np.full(m, step), places[:m], picked[:m], best, second))
            chosen.append((words, step, picked))
            steps[words] += 1
            length = lattice.length[picked]
            going = np.flatnonzero(length < left)
            places = places[going] + length[going]
            spare = lattice.spare[places]
            order = np.argsort(spare, kind="stable")
            going, places, spare = going[order], places[order], spare[order]
            words, seed, left = words[going], seed[going], left[going] - length[going]
        # Steps of few words cost less when the edges of all their places are chosen at once.
        while len(words):
            n = np.minimum(left, max(1, BATCH_CHARS // len(words))).astype(np.int64)
            ends = np.cumsum(n)
            owner, every = np.repeat(np.arange(len(words)), n), _expand(places, n)
            spare = lattice.spare[every]
            order = np.argsort(spare, kind="stable")
            sorted_picked, best, second = self._choose(seed[owner[order]], every[order], lattice.left[every[order]], spare[order])
            picked, rank = np.empty_like(sorted_picked), np.empty_like(order)
            picked[order], rank[order] = sorted_picked, np.arange(len(order))
            passed, moved = [], []
            lengths = lattice.length[picked].tolist()
            for at, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
                start = at
                while at < end:
                    passed.append(at)
                    at += lengths[at]
                moved.append(at - start)
            own = owner[passed]
            taken = np.bincount(own, minlength=len(words))
            step = steps[words[own]] + np.arange(len(own)) - (np.cumsum(taken) - taken)[own]
            chosen.append((words[own], step, picked[passed]))
            steps[words] += taken
            choice = np.flatnonzero(rank[passed] < len(best))
            at = np.asarray(passed)[choice]
            choices.append((words[own[choice]], step[choice], every[at], picked[at], best[rank[at]], second[rank[at]]))
            going = np.flatnonzero(left > moved)
            words, seed, places, left = words[going], seed[going], places[going] + np.asarray(moved)[going], left[going] - np.asarray(moved)[going]
        if not choices:
            return steps, chosen, (np.empty(0, np.int64),) * 6
        return steps, chosen, tuple(np.concatenate(x) for x in zip(*choices, strict=True))

    def run(self) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Per round of up to ``k`` (documents, log p, value, edges, their ends by document); thresholds, or -inf."""
        docs = len(self.counts)
        out = []
        value = _noise(_hashed(self.keys, np.full(docs, 1 << 40)))
        active = np.arange(docs)
        copied = (np.empty(0, np.int64),) * 3
        words, places = np.arange(len(self.word)), self.lattice.first[self.word]
        for turn in range(self.k):
            steps, drawn, choices = self._walk(words, places, turn)
            word, step, edge = copied
            before = np.bincount(word, minlength=len(self.word))  # a word's steps are numbered from 0, so each has its place
            first = np.append(0, np.cumsum(before + steps))
            edges = np.empty(first[-1], np.int64)
            edges[first[word] + step] = edge
            fresh = first[:-1] + before
            for words, step, picked in drawn:
                edges[fresh[words] + step] = picked
            self.paths.append((edges, first))
            chance = self.lattice.chance[edges]
            total = np.append(0.0, np.cumsum(chance))
            cut = first[np.append(0, self.last)]
            log_p = np.zeros(docs)
            held = np.flatnonzero(cut[1:] > cut[:-1])
            if len(held):
                log_p[held] = np.add.reduceat(chance, cut[held])
            out.append((active, log_p[active], value[active], edges, cut[active + 1]))
            self._open(turn, choices, before, first, total, cut, value)
            active, value, copied, words, places = self._next(turn, value)
            if not len(active):
                break
        threshold = np.full(docs, -np.inf)
        if len(out) == self.k:
            threshold[self.frontier[0]] = self.frontier[1]
        return out, threshold

    def _ranks(self, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by document, largest values first, and the ranks in it."""
        by = np.lexsort((-value, doc))
        ranked, doc = np.arange(len(by)), doc[by]
        new = np.append(True, doc[1:] != doc[:-1])[: len(by)]
        return by, ranked - np.maximum.accumulate(np.where(new, ranked, 0))

    def _best(self, doc: np.ndarray, limited: np.ndarray, value: np.ndarray, wanted: int) -> np.ndarray:
        """The ``wanted`` largest of each document, in order."""
        # Few entries are needed; most documents have them close below their value.
        close = limited > value[doc] - 8.0
        few = np.bincount(doc[close], minlength=len(self.counts)) < wanted
        some = np.flatnonzero(close | few[doc])
        by, rank = self._ranks(doc[some], limited[some])
        return some[by[rank < wanted]]

    def _open(self, turn, choices, before, first, total, cut, value) -> None:
        """Put the best of the passed-over edges into the documents' frontiers."""
        word, step, place, picked, best, second = choices
        if not len(word):
            return
        wanted = self.k + 1 - turn
        words_above = value[self.doc] - (total[first[:-1]] - total[cut[self.doc]])

        def limited(of: np.ndarray, perturbed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            doc, at = self.doc[word[of]], first[word[of]]
            top = value[doc]
            above = words_above[word[of]] - (total[at + before[word[of]] + step[of]] - total[at])
            below = above - perturbed + np.log1p(-np.exp(np.minimum(perturbed - best[of], -1e-300)))
            return doc, top - np.maximum(below, 0.0) - np.log1p(np.exp(-np.abs(below)))

        # The best edges of a document are among those that leave the places with the best second edges.
        # Those of later words lie far below unless a second value all but equals the first: log(1 - exp(-1e-6)) > -14.
        near = (words_above[word] - second < 22.0) | (best - second < 1e-6)
        nodes = np.flatnonzero(near)
        doc, bound = limited(nodes, second[nodes])
        few = np.bincount(doc[bound > value[doc] - 8.0], minlength=len(self.counts)) < wanted
        if few.any():
            nodes = np.flatnonzero(near | few[self.doc][word])
            doc, bound = limited(nodes, second[nodes])
        nodes = nodes[self._best(doc, bound, value, wanted)]
        lattice = self.lattice
        nodes = nodes[np.argsort(lattice.spare[place[nodes]], kind="stable")]
        places, n = place[nodes], lattice.most - lattice.spare[place[nodes]].astype(np.int64)
        leaving = [int(np.count_nonzero(n > j)) for j in range(int(n[0]))]
        edge, perturbed, _ = self._perturbed(self._seed(word[nodes], turn), places, lattice.left[places], lattice.edges[places], leaving)
        node = np.concatenate([nodes[:m] for m in leaving])
        other = np.flatnonzero(edge != picked[node])
        edge, node = edge[other], node[other]
        doc, bound = limited(node, perturbed[other])
        by = self._best(doc, bound, value, wanted)
        node = node[by]
        opened = (doc[by], bound[by], np.full(len(by), turn), word[node], before[word[node]] + step[node], place[node], edge[by])
        self.frontier = tuple(np.concatenate(x) for x in zip(self.frontier, opened, strict=True))

    def _next(self, turn: int, value: np.ndarray):
        """Take the best open entry of every document; what it shares with its parent, and what is to be drawn."""
        none = np.empty(0, np.int64)
        by, rank = self._ranks(*self.frontier[:2])
        taken = tuple(x[by[rank == 0]] for x in self.frontier)
        if turn + 1 == self.k or not len(by):  # only the values of the next ones matter: the thresholds
            self.frontier = taken
            return none, value, (none,) * 3, none, none
        rest = by[(rank > 0) & (rank <= self.k - turn)]
        self.frontier = tuple(x[rest] for x in self.frontier)
        active, best, parent, word, step, place, edge = taken
        value = value.copy()
        value[active] = best
        copies = [(word, step, edge)]
        for p in range(turn + 1):
            edges, first = self.paths[p]
            own = np.flatnonzero(parent == p)
            a = first[self.last[active[own]] - self.counts[active[own]]]
            shared = _expand(a, first[word[own]] + step[own] - a)
            owner = np.searchsorted(first, shared, "right") - 1
            copies.append((owner, shared - first[owner], edges[shared]))
        copied = tuple(np.concatenate(x) for x in zip(*copies, strict=True))
        lattice = self.lattice
        begun = np.flatnonzero(lattice.length[edge] < lattice.left[place])
        later = _expand(word + 1, self.last[active] - (word + 1))
        words = np.concatenate([word[begun], later])
        places = np.concatenate([place[begun] + lattice.length[edge[begun]], lattice.first[self.word[later]]])
        return active, value, copied, words, places


class _Numbers(dict):
    """Numbers in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, trailing spaces behind a sign of their own, and the number of words of each text."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    units, sizes = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    empty = np.flatnonzero(pc.binary_length(units).to_numpy() == 0)
    if not len(empty):
        return units, sizes
    spaced = np.unique(owner[empty])  # texts with leading, trailing or several spaces, or none at all
    words, own = [], []
    for i in spaced.tolist():
        found, trailing = space_words(texts[i]) if texts[i] else ([], 0)
        found += ["\0" + " " * trailing] if trailing else []
        words += found
        own.append(len(found))
    others = np.ones(len(texts), bool)
    others[spaced] = False
    plain = np.flatnonzero(others[owner])
    both = pa.concat_arrays([units.take(pa.array(plain)), pa.array(words, pa.large_string())])
    sizes[spaced] = own
    return both.take(pa.array(np.argsort(np.append(owner[plain], np.repeat(spaced, own)), kind="stable"))), sizes


def segmentations(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """Per text up to ``k`` of (log p, perturbed value, inclusion, ids)."""
    if v.lattice is not None and len(v.lattice.left) > KEPT_CHARS:
        v.forget()
    numbers = v.numbers
    units, sizes = _units(texts)
    coded = units.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    numbered = np.asarray([numbers[u] for u in distinct], np.int64)[coded.indices.to_numpy()]
    lattice = v.lattice_of(numbers)
    first = np.cumsum(sizes) - sizes
    part = (np.cumsum([len(t) for t in texts]) - 1) // BATCH_CHARS  # documents by where they end
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    out: list[list[tuple[float, float, float, np.ndarray]]] = [[] for _ in texts]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            own = numbered[first[a] : first[b - 1] + sizes[b - 1]]
            rounds, threshold = Search(own, sizes[a:b], keys[a:b], lattice, k).run()
            for docs, log_p, value, edges, ends in rounds:
                ids, ends = v.ids_of(lattice.piece[edges], ends)
                inclusion = -np.expm1(-np.exp(np.minimum(log_p - threshold[docs], 700.0)))
                starts = np.append(0, ends[:-1])
                for d, *row, i, j in zip(*(x.tolist() for x in (docs, log_p, value, inclusion, starts, ends)), strict=True):
                    out[a + d].append((*row, ids[i:j]))
    return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
    ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32())),
])


def _sample(model: str, k: int, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept(("vocabulary", model), lambda: Vocabulary(model))

        def emit(names: list, texts: list[str]) -> pa.RecordBatch:
            keys = mixed(np.asarray([-1 if n is None else n for n in names], np.int64).astype(_U64) + _U64(seed))
            rows: list[list] = [[] for _ in range(6)]
            pieces, good, owners = [np.empty(0, np.int32)], [], []
            for name, text, samples in zip(names, texts, segmentations(texts, keys, v, k), strict=True):
                for i, (log_p, value, inclusion, ids) in enumerate(samples, 1):
                    for column, x in zip(rows, (name, i, len(ids), log_p, value, inclusion), strict=True):
                        column.append(x)
                    pieces.append(ids)
                    owners.append(text)
            flat = np.concatenate(pieces).astype(np.int32)
            ends = np.cumsum([0, *rows[2]])
            held, cuts = memoryview(flat.astype("<u4").view(np.uint8)), (4 * ends).tolist()
            crc = [zlib.crc32(held[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            spelled, offsets = text_bytes(v.spelled.take(pa.array(flat)))
            spelled, cuts = spelled.tobytes(), offsets[ends].tolist()
            for text, a, b in zip(owners, cuts[:-1], cuts[1:], strict=True):
                good.append(spelled[a + (spelled[a : min(a + 1, b)] == b" ") : b] == text.encode())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)) if with_ids else pa.nulls(len(crc), pa.list_(pa.int32()))
            columns = [pa.array(c, f.type) for c, f in zip([*rows, crc, good], _SCHEMA, strict=False)]
            return pa.RecordBatch.from_arrays([*columns, lists], schema=_SCHEMA)

        for batch in batches:
            names, texts, held = [], [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= GROUP_CHARS:
                    yield emit(names, texts)
                    names, texts, held = [], [], 0
            if names:
                yield emit(names, texts)

    return run


def sample_segmentations(
    docs: DataFrame, model: str, k: int = 3, seed: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``k`` rows per document: ``doc_id, sample, n_pieces, log_prob, perturbed, inclusion, ids_crc32, round_trip, ids``."""
    own = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return own.mapInArrow(
        _sample(model, k, seed, with_ids),
        "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, "
        "round_trip boolean, ids array<int>",
    )
