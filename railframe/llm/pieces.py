"""N-best SentencePiece segmentation and decoding.

A text's piece lattice has an edge for every vocabulary piece; a path's score is the sum of its pieces' scores. Forward
Viterbi scores of all positions are the exact remaining costs for an A-star search that runs backward from the end: what an
edge loses against the best way to its end is known, so complete paths come off the heap best first, and of what is on it
only as many entries are kept as paths are wanted. The search is linear in the length of a text, with or without spaces.

No path crosses two characters that no piece holds side by side, such as a letter and the comma behind it, so a text's
lattice is a chain of the lattices of its parts. Each distinct part is solved once per worker (in a bounded cache), the new
ones of a batch together, position by position over all of them; and a document's N best paths change at most the N - 1
parts whose second path costs least, which are searched.
A character without a piece becomes its bytes' pieces, as one edge below every other score.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, prepare

MARK = "▁"
#: Parts that a worker's cache holds before it starts anew.
CACHE_PARTS = 1_000_000
#: Parts of at most so many characters are solved together, so many at a time.
SHORT, TOGETHER = 48, 20_000
#: Characters, those of the most pieces, that parts solved together may have.
COMMON = 160
NEVER = float("inf")
#: start, end, score, ids
Edge = tuple[int, int, float, tuple[int, ...]]


class Lattice:
    """The pieces of a model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {names[i]: (i, float(model.get_score(i))) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.pieces))
        self.below = min(s for _, s in self.pieces.values()) - 10.0
        raw = {i: names[i].encode() for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()} | {self.unknown: " ⁇ ".encode()}
        self.raw = Ragged(np.uint8).extended([raw.get(i, b"") for i in range(n)])
        self.single = {p for p in self.pieces if len(p) == 1}
        #: Characters side by side in a piece.
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.split = self.splitter()
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.grow_tree()
        self.forget()

    def splitter(self) -> re.Pattern:
        """Cuts a text only where no piece crosses: before marks, and, if the model allows it, between letters or digits and
        other characters."""
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            return re.compile("(?s).+")
        # Letters and digits that stand beside other characters in a piece count as such, and what then stands beside those.
        odd: set[str] = set()
        inside = lambda c: c.isalnum() and c not in odd
        while more := {c for x, y in self.pairs if x != MARK and inside(x) != inside(y) for c in (x, y) if inside(c)}:
            odd |= more
        if len(odd) > 100:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        own = re.escape("".join(sorted(odd)))
        return re.compile(rf"{MARK}*(?:[^\W_{own}]+|[^\w{MARK}]+|[_{own}]+)|{MARK}+")

    # --- one part ---------------------------------------------------------------------------------
    def edges(self, part: str) -> list[list[Edge]]:
        """For each end position the edges that reach it, longest first."""
        out: list[list[Edge]] = [[]]
        get, longest = self.pieces.get, self.longest
        for end in range(1, len(part) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                found = get(part[start:end])
                if found is not None:
                    here.append((start, end, found[1], (found[0],)))
            if part[end - 1] not in self.single:
                here.append((end - 1, end, self.below, tuple(self.bytes.get(b, self.unknown) for b in part[end - 1].encode("utf-8", "surrogatepass"))))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list[list[Edge]]) -> list[float]:
        """The best score of a path from the start to each position."""
        best = [0.0]
        for here in edges[1:]:
            best.append(max([best[start] + score for start, _, score, _ in here]))
        return best

    def paths(self, part: str, most: int) -> list[tuple[float, bytes]]:
        """The best `most` paths, best first: what each loses against the best one, and its ids."""
        if not part:
            return [(0.0, b"")]
        edges = self.edges(part)
        best = self.forward(edges)
        # (loss, position, tie, the pieces behind the position as a linked list); of equals the one that has come farthest is first.
        heap: list = [(0.0, len(part), 0, None)]
        # Entries stand for different paths, so no more than `most` of them, the least, can matter: their losses, negated.
        kept, made, found = [0.0], 0, []
        while heap and len(found) < most:
            loss, at, _, behind = heapq.heappop(heap)
            if not at:
                ids = array("I")
                while behind is not None:
                    ids.extend(behind[0])
                    behind = behind[1]
                found.append((loss, ids.tobytes()))
                continue
            top, same = best[at], False
            for start, _, score, ids in edges[at]:
                more = loss + (top - (best[start] + score))
                if more == loss and not same:
                    same = True  # goes on with the entry itself
                elif len(kept) < most:
                    heapq.heappush(kept, -more)
                elif more < -kept[0]:
                    heapq.heapreplace(kept, -more)
                else:
                    continue
                made += 1
                heapq.heappush(heap, (more, start, made, (ids, behind)))
        return found

    def ranked(self, part: str, most: int) -> list[tuple[float, bytes]]:
        """paths of a part, kept for short ones: the parts that change for least are few."""
        if len(part) > SHORT:
            return self.paths(part, most)
        found = self.searched.get((part, most))
        if found is None:
            if len(self.searched) >= CACHE_PARTS // 10:
                self.searched.clear()
            found = self.searched[part, most] = self.paths(part, most)
        return found

    def solved(self, part: str) -> tuple[float, bytes, float]:
        """The best path's score and ids, and what the second loses: that leaves the best one once, at a position of it, for the
        runner-up there (infinite: there is none)."""
        best, links, gaps = [0.0], [(0, ())], [NEVER]
        for end, here in enumerate(self.edges(part)[1:], 1):
            top, gap, link = -NEVER, NEVER, (0, ())
            for start, _, score, ids in here:
                s = best[start] + score
                if s > top:
                    top, gap, link = s, s - top, (end - start, ids)
                elif top - s < gap:
                    gap = top - s
            best.append(top)
            links.append(link)
            gaps.append(gap)
        at, path, second = len(part), [], NEVER
        while at:
            length, ids = links[at]
            second = min(second, gaps[at])
            path.append(ids)
            at -= length
        return best[-1], array("I", chain.from_iterable(reversed(path))).tobytes(), second

    # --- many parts -------------------------------------------------------------------------------
    def grow_tree(self) -> None:
        """The pieces of common characters as a prefix tree: a table of (node, character) -> node, and each node's piece."""
        count = Counter(c for p in self.pieces for c in set(p) if c in self.single)
        self.common = {c: i for i, c in enumerate(sorted(c for c, _ in count.most_common(COMMON)))}
        nodes, tails = {"": 0}, {}
        for piece, found in self.pieces.items():
            if all(c in self.common for c in piece):
                for i in range(1, len(piece) + 1):
                    nodes.setdefault(piece[:i], len(nodes))
                tails[nodes[piece]] = found
        self.next = np.zeros((len(nodes), len(self.common) + 1), np.int32)
        for name, node in nodes.items():
            if name:
                self.next[nodes[name[:-1]], self.common[name[-1]]] = node
        self.tail = np.full(len(nodes), -1, np.int64)
        self.score_of = np.zeros(len(nodes))
        for node, (i, score) in tails.items():
            self.tail[node], self.score_of[node] = i, score
        self.code = np.full(0x110000, len(self.common), np.int16)  # characters that are not common end every piece
        for c, i in self.common.items():
            self.code[ord(c)] = i

    def together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """solved for many parts of common characters at once: scores, losses of the second paths, ids one after another, ids of each."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # where each part's position 0 is; its characters follow
        codes = self.code[np.frombuffer(("\0" + "\0".join(parts) + "\0").encode("utf-32-le"), np.uint32)]
        n = len(codes) - 1
        place = np.arange(n) - np.repeat(first, size + 1)
        start, node = np.arange(n), np.zeros(n, np.int64)
        starts, ends, nodes = [], [], []
        for length in range(1, self.longest + 1):
            node = self.next[node, codes[start + length]]
            alive = np.flatnonzero(node)
            start, node = start[alive], node[alive]
            if not len(start):
                break
            whole = np.flatnonzero(self.tail[node] >= 0)
            starts.append(start[whole])
            ends.append(start[whole] + length)
            nodes.append(node[whole])
        start, end, node = map(np.concatenate, (starts, ends, nodes))
        by = np.argsort((place[end] * (n + 1) + end) * (self.longest + 1) - (end - start))  # by place, part, longest first
        start, end, node = start[by], end[by], node[by]
        score = self.score_of[node]
        steps = np.searchsorted(place[end], np.arange(1, size.max() + 2))
        best, gap = np.zeros(n), np.full(n, NEVER)
        came, piece = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a, b in pairwise(steps):
            s = best[start[a:b]] + score[a:b]
            here = end[a:b]
            group = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            top = np.maximum.reduceat(s, group)
            is_top = np.flatnonzero(s == np.repeat(top, np.diff(np.concatenate([group, [b - a]]))))
            chosen = is_top[np.searchsorted(is_top, group)]
            s[chosen] = -NEVER
            at = here[group]
            best[at], gap[at] = top, top - np.maximum.reduceat(s, group)
            came[at], piece[at] = start[a:b][chosen], self.tail[node[a:b][chosen]]
        at, second, own = first + size, np.full(len(parts), NEVER), np.arange(len(parts))
        score, taken, owner = best[at], [], []
        while len(own):
            pos = at[own]
            second[own] = np.minimum(second[own], gap[pos])
            taken.append(piece[pos])
            owner.append(own)
            at[own] = came[pos]
            own = own[came[pos] > first[own]]
        taken, owner = np.concatenate(taken[::-1]), np.concatenate(owner[::-1])
        return score, second, taken[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(parts))

    def forget(self) -> None:
        """An empty cache."""
        self.known = Numbered()
        self.score, self.second, self.ids = Grown(np.float64), Grown(np.float64), Ragged(np.uint32)

    def learn(self) -> None:
        """Solve the parts that were numbered since: short ones of common characters together, others one by one."""
        parts, self.known.fresh = self.known.fresh, []
        if not parts:
            return
        usual = self.common.keys()
        is_short = np.array([len(p) <= SHORT and usual >= set(p) for p in parts])
        short, others = np.flatnonzero(is_short), np.flatnonzero(~is_short)
        scores, seconds, found = Grown(np.float64), Grown(np.float64), Ragged(np.uint32)
        for at in range(0, len(short), TOGETHER):
            score, second, ids, sizes = self.together([parts[i] for i in short[at : at + TOGETHER]])
            scores.extend(score)
            seconds.extend(second)
            found.extend(ids, sizes)
        if len(others):
            score, ids, second = zip(*(self.joined(parts[i]) for i in others))
            scores.extend(np.array(score))
            seconds.extend(np.array(second))
            found.extended(ids)
        order = np.argsort(np.concatenate([short, others]))
        self.score.extend(scores.held[order])
        self.second.extend(seconds.held[order])
        self.ids.extend(found.taken(order), found.sizes.held[order])

    def joined(self, part: str) -> tuple[float, bytes, float]:
        """A part cut wherever two characters are in no piece: the best paths one after another, and the cheapest of the second ones."""
        cuts = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.pairs), len(part)]
        smaller = [part[a:b] for a, b in pairwise(cuts)]
        found = {p: self.solved(p) for p in set(smaller)}
        scores, ids, seconds = zip(*map(found.__getitem__, smaller))
        return sum(scores), b"".join(ids), min(seconds)

    # --- texts ------------------------------------------------------------------------------------
    def normalised(self, text: str | None) -> str:
        """White space marked as the model was trained: a mark before the text and for every space."""
        return MARK + text.replace(" ", MARK) if text else ""

    def nbest(self, text: str | None, most: int) -> list[tuple[float, bytes]]:
        """Scores and ids (unsigned 32-bit, native order) of the best `most` segmentations of the whole text, best first; of
        an empty text the empty one."""
        return next(self.nbests([text], most))

    def nbests(self, texts: list[str | None], most: int) -> Iterator[list[tuple[float, bytes]]]:
        """nbest of each text."""
        if len(self.known) >= CACHE_PARTS:
            self.forget()
        split = [self.split.findall(self.normalised(t)) for t in texts]
        numbers = [np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)) for parts in split]
        self.learn()
        for parts, own in zip(split, numbers):
            yield self.best(parts, own, most) if parts else [(0.0, b"")]

    def best(self, parts: list[str], own: np.ndarray, most: int) -> list[tuple[float, bytes]]:
        score, ids = float(self.score.held[own].sum()), self.ids.taken(own).tobytes()
        found = [(score, ids)]
        if most < 2:
            return found
        # Any other part changes for more than each of these alone.
        second = self.second.held[own]
        order = np.argpartition(second, most - 2)[: most - 1] if len(own) >= most else np.arange(len(own))
        ways: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
        for i in sorted(order[second[order] < NEVER].tolist()):
            options = self.ranked(parts[i], most)
            ways = sorted([(loss + more, (*chosen, (i, other)) if n else chosen) for loss, chosen in ways for n, (more, other) in enumerate(options)], key=itemgetter(0))[:most]
        ends = 4 * np.cumsum(self.ids.sizes.held[own])
        for loss, chosen in ways[1:]:
            changed, at = [], 0
            for i, other in chosen:
                changed += (ids[at : ends[i - 1] if i else 0], other)
                at = ends[i]
            found.append((score - loss, b"".join((*changed, ids[at:]))))
        return found

    def decoded(self, ids: bytes) -> str:
        """The text of a segmentation."""
        raw = self.raw.taken(np.frombuffer(ids, np.uint32)).tobytes().decode("utf-8", "surrogatepass")
        return raw.replace(MARK, " ").removeprefix(" ")


class Numbered(dict):
    """part -> its number, in order of appearance; fresh: those not solved yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.fresh.append(part)
        return number


class Grown:
    """An array with room to grow."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), len(values)), self.held.dtype)])
        self.held[self.n : end] = values
        self.n = end


class Ragged:
    """Rows of different sizes, one after another in one array."""

    def __init__(self, kind: type):
        self.flat, self.starts, self.sizes = Grown(kind), Grown(np.int64), Grown(np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(flat)

    def extended(self, rows: Sequence[bytes]) -> Ragged:
        kind = self.flat.held.dtype
        self.extend(np.frombuffer(b"".join(rows), kind), np.array(list(map(len, rows))) // kind.itemsize)
        return self

    def taken(self, rows: np.ndarray) -> np.ndarray:
        """The given rows one after another."""
        sizes = self.sizes.held[rows]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts.held[rows] - ends + sizes, sizes)
        return self.flat.held[shift + np.arange(len(shift))]


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One for each Python worker."""
    return Lattice(path)


def segmented(docs: DataFrame, model: str, most: int = 5, with_ids: bool = False) -> DataFrame:
    """The best `most` segmentations of every whole text: doc_id, n_best, score and n_pieces of the best, scores of all
    (best first), crc32 of each one's ids as little-endian unsigned 32-bit integers, decodes (whether the best gives the
    text again) and, if asked for, the ids of each. A null text is empty: one segmentation without pieces.
    """
    prepare(docs.sparkSession)
    ddl = "doc_id long, n_best int, n_pieces long, score double, scores array<double>, ids_crc32 array<long>, decodes boolean" + ", ids array<array<long>>" * with_ids
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(model)
        for b in batches:
            rows = []
            texts = b["text"].to_pylist()
            for doc, text, best in zip(b["doc_id"].to_pylist(), texts, net.nbests(texts, most)):
                row = (doc, len(best), len(best[0][1]) // 4, best[0][0], [s for s, _ in best], [zlib.crc32(i) for _, i in best], net.decoded(best[0][1]) == (text or ""))
                rows.append(row + (([np.frombuffer(i, np.uint32).astype(np.int64) for _, i in best],) if with_ids else ()))
            yield out_batch(out, list(zip(*rows)) or [[]] * len(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
