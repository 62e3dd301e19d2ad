"""Bit model of texts by online logistic context mixing (numpy, no Spark).

A text is its bytes and one end symbol.  Every symbol is a path of bits through a
Huffman tree, so a common letter takes two or three predictions.  For each bit,
several predictors look up the two counts of (hashed context of the last 2, 3 or 4
symbols, tree node); their log odds are mixed with weights that a gate selects (the
longest context that was seen), and a map over (tree node, mixed odds) refines the
result.  One more predictor follows the latest earlier place of the same text with the
same seven symbols; it is mixed in by a second gate, the class of the match's length.
While a text is scored, its own corrections of all these weights are learned online, at
every symbol: after each block they take a step against the coding error of that block,
so a prediction depends on what came before and on the model alone.

The counts and their odds depend on the last four symbols alone, so within a piece of
text every different run of five symbols is counted and looked up once, with its number.
The symbols after a text's first block are mixed one by one, with what it has learned.

Counts are sums over all training texts.  Gated weights, refinement and trust in matches
are fitted on all training texts too, each symbol against the counts without its own
(leave one out), from sums of fixed size that add up over any split of the texts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END = 256
ORDERS = (2, 3, 4)
TABLE_BITS = (20, 20, 22)            # slots of each order's table
MATCH = 7                            # symbols that a match must share
SHORT = 2                            # a match counts after so many symbols in a row
LENGTHS = 8                          # classes of match length, 0 for none
BLOCK = 512                          # symbols between two steps of a text's own correction
GROUP = 512                          # texts whose matches take a block together
AT_ONCE = 1 << 15                    # symbols of different texts mixed together
PIECE_BITS = 17
PIECE = 1 << PIECE_BITS              # symbols counted or mixed together
SHARED = 1 << 20                     # symbols whose different runs are looked up once
FOUND = 1 << 19                      # symbols with a match whose steps are counted together
MERGED = 1 << 20                     # different runs of pieces that are counted together
RATE, OWN_LIMIT = 0.3, 0.8           # step and bound of a text's own correction
STEPS = 24                           # classes of mixed odds on either side of even
SCALE = 16                           # log odds are stored in sixteenths
U, L = np.uint32, np.uint64
_LN2 = float(np.log(2.0))


def code_paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The (node, bit) path of every symbol in the Huffman tree of ``counts``."""
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    kids, top = {}, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[top] = (a[1], b[1])
        heapq.heappush(heap, (a[0] + b[0], top))
        top += 1
    paths, open_nodes = [[] for _ in counts], [(heap[0][1], [])]
    while open_nodes:
        x, path = open_nodes.pop()
        if x < len(counts):
            paths[x] = path
        else:
            open_nodes += [(kid, [*path, (x - len(counts), bit)]) for bit, kid in enumerate(kids[x])]
    return paths


class Code:
    """The tree as arrays: path length and start per symbol, node and bit per step."""

    def __init__(self, counts: np.ndarray):
        paths = code_paths(counts)
        self.length = np.array([len(p) for p in paths])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.node = np.array([n for p in paths for n, _ in p], np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], np.float32)
        # Bits that the paths of two symbols share.
        n = len(paths)
        self.shared = np.zeros((n + 1, n), np.int64)
        for a in range(n):
            for b in range(a):
                k = 0
                while paths[a][k] == paths[b][k]:
                    k += 1
                self.shared[a, b] = self.shared[b, a] = k
            self.shared[a, a] = len(paths[a])

    def steps(self, symbols: np.ndarray):
        """(bits of each symbol, index into ``node`` and ``bit`` of every bit, depth)."""
        size = self.length[symbols]
        ends = np.cumsum(size)
        depth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return size, np.repeat(self.start[symbols], size) + depth, depth


def joined(texts: list[bytes]):
    """(symbols of all texts, each with its end; place in the text; sizes)."""
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(size)
    symbols[ends - 1] = END
    return symbols, np.arange(len(symbols)) - np.repeat(ends - size, size), size


def recent(symbols: np.ndarray, place: np.ndarray, most: int = ORDERS[-1]):
    """The four (``most`` of them) or ``MATCH`` symbols before every symbol, packed (9 bits
    each, 0 before the text)."""
    one = np.zeros(len(symbols), np.uint64)
    one[1:] = symbols[:-1] + 1

    def longer(latest, older, by):        # ``older`` ends ``by`` symbols earlier
        out = latest.copy()
        out[by:] |= older[:-by or None] << L(9 * by)
        return out

    two = longer(one, one, 1)
    known = four = longer(two, two, 2)
    if most > ORDERS[-1]:
        known = longer(longer(four, two, 4), one, 6)
    early = np.flatnonzero(place < most)
    known[early] &= (L(1) << (L(9) * place[early].astype(np.uint64))) - L(1)
    return known


def with_own(known: np.ndarray, symbols: np.ndarray):
    """Every symbol with the four before it, packed, from those before it (``recent``)."""
    return ((known & L((1 << 36) - 1)) << L(9)) | (symbols + 1).astype(np.uint64)


def runs(symbols: np.ndarray, place: np.ndarray):
    """Every symbol with the four before it, and the ``MATCH`` before it, packed."""
    last = recent(symbols, place, MATCH)
    return with_own(last, symbols), last


def in_order(run: np.ndarray):
    """(different runs, number of each, runs in order with their places) of one piece."""
    order = np.sort(run << L(PIECE_BITS) | np.arange(len(run), dtype=np.uint64))
    key = order >> L(PIECE_BITS)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begins], np.diff(np.append(begins, len(run))), order


def distinct(run: np.ndarray):
    """(different runs, index of each symbol's, number of each) of one piece."""
    key, number, order = in_order(run)
    which = np.empty(len(run), np.int64)
    which[(order & L(PIECE - 1)).astype(np.int64)] = np.repeat(np.arange(len(key)), number)
    return key, which, number


def contexts(run: np.ndarray) -> list[np.ndarray]:
    """The hashed last 2, 3 and 4 symbols (one array per order) of runs."""
    out, h = [], np.zeros(len(run), np.uint32)
    for back in range(1, ORDERS[-1] + 1):
        before = ((run >> L(9 * back)) & L(511)).astype(np.uint32)
        h = (h + before + U(back)) * U(0x2F0B4C47)
        h ^= h >> U(15)
        if back in ORDERS:
            out.append(h)
    return out


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slot of (context, node) in a table of 2^bits."""
    return ((context + node * U(0x9E3779B1)) * U(0x85EBCA6B)) >> U(32 - bits)


def followed(symbols: np.ndarray, place: np.ndarray, last: np.ndarray):
    """The symbols with a match: index, the symbol that followed the latest earlier place
    of the same text with the same last ``MATCH`` symbols, and the class of the length."""
    begin = (np.arange(len(symbols)) - place).astype(np.uint64)
    key = (last * L(0x9E3779B97F4A7C15) ^ begin * L(0xC2B2AE3D27D4EB4F)) >> L(32) << L(32)
    order = np.sort(key | np.arange(len(symbols), dtype=np.uint64))
    at, key = (order & L(0xFFFFFFFF)).astype(np.int64), order >> L(32)
    near = np.flatnonzero(key[1:] == key[:-1])
    now, then = at[near + 1], at[near]
    same = (then - now + place[now] >= MATCH) & (last[now] == last[then])
    before = np.full(len(symbols), -1)
    before[now[same]] = then[same]
    now = np.flatnonzero(before >= 0)
    then = before[now]
    fresh = np.ones(len(now), bool)
    fresh[1:] = (now[1:] != now[:-1] + 1) | (then[1:] != then[:-1] + 1)
    at = np.arange(len(now))
    run = at - np.maximum.accumulate(at * fresh) + 1
    long = run >= SHORT
    return now[long], symbols[then[long]], KINDS[np.minimum(run[long], len(KINDS) - 1)]


# The class of match length by the number of symbols in a row.
KINDS = np.minimum(1 + np.log2(np.maximum(np.arange((SHORT << LENGTHS) + 1), SHORT).astype(np.float32)
                               / SHORT).astype(np.int64), LENGTHS - 1)


class Counter:
    """Counts of (context, node) by bit over all texts added."""

    def __init__(self, code: Code):
        self.code = code
        self.tables = [np.zeros(2 << b, np.int32) for b in TABLE_BITS]
        self.waiting: list[bytes] = []
        self.held = 0
        self.runs: list[np.ndarray] = []     # runs packed with their number less one
        self.kept = 0

    def add(self, texts: list[bytes]):
        for t in texts:
            self.waiting.append(t)
            self.held += len(t) + 1
            if self.held >= PIECE:
                self._collect()

    def _collect(self):
        if self.waiting:
            run = self._runs(*joined(self.waiting)[:2])
            for first in range(0, len(run), PIECE):
                key, number, _ = in_order(run[first:first + PIECE])
                self.runs.append(key << L(PIECE_BITS) | (number - 1).astype(np.uint64))
                self.kept += len(key)
        self.waiting, self.held = [], 0
        if self.kept >= MERGED:
            self._merge()

    def _runs(self, symbols, place):
        return with_own(recent(symbols, place), symbols)

    def _merge(self):
        packed = np.sort(np.concatenate(self.runs))
        key = packed >> L(PIECE_BITS)
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        number = np.add.reduceat((packed & L(PIECE - 1)).astype(np.int64) + 1, begins)
        for first in range(0, len(begins), PIECE // 4):
            part = slice(first, first + PIECE // 4)
            self._count(key[begins[part]], number[part])
        self.runs, self.kept = [], 0

    def flush(self):
        self._collect()
        if self.runs:
            self._merge()

    def _count(self, run, number):
        size, step, _ = self.code.steps((run & L(511)).astype(np.int64) - 1)
        node, bit = self.code.node[step], self.code.bit[step].astype(np.uint32)
        times = np.repeat(number, size).astype(np.uint64)
        for table, h, bits in zip(self.tables, contexts(run), TABLE_BITS):
            cell = slots(np.repeat(h, size), node, bits) * U(2) + bit
            cell = np.sort(cell.astype(np.uint64) << L(32) | times)
            where = (cell >> L(32)).astype(np.int64)
            begins = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            table[where[begins]] += np.add.reduceat((cell & L(0xFFFFFFFF)).astype(np.int32), begins)


def odds(table: np.ndarray) -> np.ndarray:
    """Stored log odds of every slot: 0 where nothing was seen."""
    zero, one = table[0::2].astype(np.float32), table[1::2].astype(np.float32)
    x = np.log((one + np.float32(0.4)) / (zero + np.float32(0.4)))
    return np.clip(np.rint(SCALE * x), -127, 127).astype(np.int8)


N_IN = len(ORDERS) + 1               # the orders and a constant
GATES = len(ORDERS) + 1


# What is known of a step beforehand: the gated mix of its inputs, the middle of its row in
# the refinement, the inputs in sixteenths; 16 bytes, to be taken together.
SAID = np.dtype([("mix", np.float32), ("row", np.float32), ("x", np.int8, N_IN), ("", np.int32)])


@dataclass
class Model:
    code: Code
    odds: list[np.ndarray]           # int8 per order
    weights: np.ndarray              # (gate, input)
    refine: np.ndarray               # log odds by (node, class of mixed odds)
    trust: np.ndarray                # (2, class of match length): of the mixed odds, of the match


def inputs(model: Model, run: np.ndarray, left: list[np.ndarray] | None = None):
    """For runs: bits of each, node and bit of every step, log odds (input, step), gate.
    With ``left`` the odds are those without the step's own bit."""
    size, step, _ = model.code.steps((run & L(511)).astype(np.int64) - 1)
    node, bit = model.code.node[step], model.code.bit[step]
    x = np.empty((N_IN, len(step)), np.float32)
    gate = np.zeros(len(step), np.int64)
    for k, (h, bits) in enumerate(zip(contexts(run), TABLE_BITS)):
        slot = slots(np.repeat(h, size), node, bits).astype(np.int64)
        seen = model.odds[k][slot] if left is None else left[k][2 * slot + bit.astype(np.int64)]
        np.multiply(seen, np.float32(1 / SCALE), out=x[k])
        gate += seen != 0
    x[-1] = 0.25
    return size, node, bit, x, gate


def _cells(node, z):
    """Cells of the refinement."""
    return node.astype(np.int64) * (2 * STEPS + 1) + np.clip(np.rint(z * 2), -STEPS, STEPS).astype(np.int64) + STEPS


def _mixed(weights, gate, x):
    return np.clip(sum(weights[gate, k] * x[k] for k in range(N_IN)), -12, 12)


def _error(z, bit):
    return bit - 1 / (1 + np.exp(-z))


def says(code: Code, sym, hope, begins, values):
    """For symbols with a match, of which ``hope`` was to come: bits of each, bit, value of
    the step, and 1 for a match that says one, -1 for zero, 0 for none."""
    size, step, depth = code.steps(sym)
    bit = code.bit[step]
    value = values[np.repeat(begins, size) + depth]
    # Up to where the paths part the match says the bit that comes, there the other one.
    far = np.repeat(code.shared[hope, sym], size) - depth
    return size, bit, value, (2 * bit - 1) * ((far > 0).astype(np.float32) - (far == 0))


class Prepared:
    """Texts ready to be scored: their symbols, matches and different runs of symbols."""

    def __init__(self, texts: list[bytes]):
        self.symbols, self.place, self.size = joined(texts)
        self.text = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        run, last = runs(self.symbols, self.place)
        self.has, self.hope, self.kind = followed(self.symbols, self.place, last)
        self.place = self.place.astype(np.int32)
        keys, which, held = [], [], 0
        for first in range(0, len(run), PIECE):
            key, at, _ = distinct(run[first:first + PIECE])
            keys.append(key)
            which.append((at + held).astype(np.int32))
            held += len(key)
        self.keys, self.which = np.concatenate(keys), np.concatenate(which)


def _refinement(model: Model) -> np.ndarray:
    """Half the refinement of the bit that comes, by node, that bit and class of the odds."""
    half = model.refine.reshape(END, -1) * np.float32(0.5)
    return np.stack([-half[:, ::-1], half], 1).ravel()


def _refined(refine, row, mixed, out):
    """Log odds after the refinement; ``row`` has the middle of every step's row."""
    cell = np.rint(2 * mixed)
    cell += row
    np.multiply(mixed, np.float32(0.5), out=out)
    out += refine[cell.astype(np.int64)]
    return out


def _symbol_costs(refined, begins):
    """Nats of the symbols whose steps begin so: one logarithm for the steps of each."""
    return np.log(np.multiply.reduceat(1 + np.exp(-refined).astype(np.float64), begins))


def _pulls(mixed, x, begins):
    """Per input and range of steps the sum of error times input, in sixteenths."""
    error = 1 / (1 + np.exp(mixed))
    return np.stack([np.add.reduceat(error * x[k], begins) for k in range(N_IN)])


def _spread(begins: np.ndarray, size: np.ndarray):
    """(``size`` numbers from each of ``begins`` on, where each of these starts)."""
    ends = np.cumsum(size)
    starts = ends - size
    out = np.repeat(begins - starts, size)
    out += np.arange(len(out))
    return out, starts


def foreseen(model: Model, keys: np.ndarray, refine: np.ndarray):
    """What the counts say of different runs, and what becomes of it in a text that has
    learned nothing yet.  Of runs: first step, nats, pulls; of steps: what later blocks start
    from (``SAID``), log odds.  Odds are those of the bit that comes, here and in ``plain``."""
    starts, costs, pulls, said, odds_, held = [], [], [], [], [], 0
    for first in range(0, len(keys), 1 << 14):
        size, node, bit, x, gate = inputs(model, keys[first:first + (1 << 14)])
        sign, step, begins = 2 * bit - 1, np.empty(len(bit), SAID), np.cumsum(size) - size
        step["mix"] = sign * sum(model.weights[gate, k] * x[k] for k in range(N_IN))
        step["x"] = (x * (sign * SCALE)).T
        step["row"] = (2 * node + bit) * len(CLASSES) + STEPS
        mixed = np.clip(step["mix"], -12, 12)
        odds_.append(_refined(refine, step["row"], mixed, np.empty(len(bit), np.float32)))
        costs.append(_symbol_costs(odds_[-1], begins))
        pulls.append(_pulls(mixed, step["x"].T, begins))
        starts.append(held + begins)
        said.append(step)
        held += len(bit)
    starts, costs, said, odds_ = (np.concatenate(v) for v in (starts, costs, said, odds_))
    return starts, costs, np.concatenate(pulls, 1), said, odds_


def plain(model: Model, parts: list[Prepared]):
    """What the model says without a match, every symbol mixed with its text's own
    correction of the weights, which takes a step after each block: for each part the first
    step and the nats of every symbol, and the log odds of the steps.

    The corrections are 0 in a text's first block, so there a run's mix is the same in every
    text; later blocks are mixed symbol by symbol."""
    keys, at = np.unique(np.concatenate([p.keys for p in parts]), return_inverse=True)
    at = np.split(at.astype(np.int32), np.cumsum([len(p.keys) for p in parts])[:-1])
    run = np.concatenate([own[p.which] for p, own in zip(parts, at)])
    refine = _refinement(model)
    starts, costs, pulls, said, calm = foreseen(model, keys, refine)
    said = said.view(np.complex128)
    size = np.concatenate([p.size for p in parts])
    bits = np.concatenate([model.code.length.astype(np.int16)[p.symbols] for p in parts])
    begin = np.cumsum(size) - size
    begins, nats, held = starts[run], costs[run], len(calm)
    later = int(bits[np.concatenate([p.place >= BLOCK for p in parts])].sum())
    z = np.concatenate([calm, np.empty(later, np.float32)])
    group = np.cumsum(np.minimum(size, BLOCK)) // AT_ONCE
    for texts in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
        own, most = np.zeros((N_IN, len(texts)), np.float32), int(size[texts].max())
        for done in range(0, most, BLOCK):
            learns = most > done + BLOCK
            if not (done or learns):
                continue
            live = np.flatnonzero(size[texts] > done)
            index, firsts = _spread(begin[texts[live]] + done, np.minimum(size[texts[live]] - done, BLOCK))
            n = np.add.reduceat(bits[index].astype(np.int64), firsts)
            if done:
                step, at = _spread(starts[run[index]], bits[index])
                seen = said[step].view(SAID)
                mixed, x = seen["mix"].copy(), [seen["x"][:, k].astype(np.float32) for k in range(N_IN)]
                for k in range(N_IN):
                    mixed += np.repeat(own[k, live] * np.float32(1 / SCALE), n) * x[k]
                np.clip(mixed, -12, 12, out=mixed)
                refined = _refined(refine, seen["row"], mixed, z[held:held + len(step)])
                nats[index] = _symbol_costs(refined, at)
                begins[index] = held + at
                held += len(step)
            if learns:
                pull = _pulls(mixed, x, at[firsts]) if done else np.add.reduceat(pulls[:, run[index]], firsts, axis=1)
                own[:, live] = np.clip(own[:, live] + RATE * pull / (SCALE * n), -OWN_LIMIT, OWN_LIMIT)
    ends = np.cumsum([len(p.which) for p in parts])[:-1]
    return list(zip(np.split(begins, ends), np.split(nats, ends))), z


def matched(model: Model, sym, hope, kind, begins, z):
    """For symbols with a match, of which ``hope`` was to come: bits of each, bit, log
    odds without the match and log odds of the match for every step.  ``z`` are odds of the
    bit that comes."""
    size, bit, base, sign = says(model.code, sym, hope, begins, z)
    return size, bit, (2 * bit - 1) * base, sign * np.repeat(model.trust[1][kind], size)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits that the model spends on every text."""
    out = np.zeros(len(texts))
    by_size = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    waiting, first, held = [], 0, 0
    while first < len(by_size):
        last, size = first, 0
        while last < len(by_size) and (size < PIECE or last == first):
            size += len(texts[by_size[last]]) + 1
            last += 1
        waiting.append(by_size[first:last])
        first, held = last, held + size
        if held >= SHARED or first == len(by_size):
            for chosen, (nats, text) in zip(waiting, symbol_nats(model, [[texts[i] for i in w] for w in waiting])):
                out[chosen] = np.bincount(text, nats, len(chosen))
            waiting, held = [], 0
    return out / _LN2


def symbol_nats(model: Model, groups: list[list[bytes]]):
    """Per group of texts: (nats that the model spends on every symbol, index of its
    text)."""
    parts = [Prepared(texts) for texts in groups]
    said, z = plain(model, parts)
    costs = _with_matches(model, parts, [begins for begins, _ in said], z)
    for p, (_, nats), cost in zip(parts, said, costs):
        nats[p.has] = cost
    return [(nats, p.text) for p, (_, nats) in zip(parts, said)]


def _with_matches(model: Model, parts: list[Prepared], begins: list[np.ndarray], z):
    """Per part the nats of every symbol with a match."""
    texts = np.cumsum([0, *(len(p.size) for p in parts)])
    symbols, hope, kind, begins, block, text = (np.concatenate(v) for v in (
        [p.symbols[p.has] for p in parts], [p.hope for p in parts], [p.kind for p in parts],
        [b[p.has] for p, b in zip(parts, begins)], [p.place[p.has] // BLOCK for p in parts],
        [p.text[p.has] + first for p, first in zip(parts, texts)]))
    # The symbols with a match, block by block of their texts.
    turn = text // GROUP * (int(block.max(initial=0)) + 1) + block
    order = np.argsort(turn, kind="stable")
    turn = turn[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])), len(turn)) if len(turn) else [0]
    own, nats = np.zeros((2, texts[-1]), np.float32), np.empty(len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        index = order[a:b]
        mine = text[index]
        firsts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        bits, bit, base, match = matched(model, symbols[index], hope[index], kind[index], begins[index], z)
        weight = model.trust[0][kind[index]] + own[0][mine]
        mixed = np.clip(np.repeat(weight, bits) * base + np.repeat(1 + own[1][mine], bits) * match, -12, 12)
        starts = np.cumsum(bits) - bits
        nats[index] = _symbol_costs((2 * bit - 1) * mixed, starts)
        error, steps = _error(mixed, bit), starts[firsts]
        n = np.diff(np.append(steps, len(bit)))
        for k, x in enumerate((base, match)):
            pull = np.add.reduceat((error * x).astype(np.float64), steps) / n
            of = mine[firsts]
            own[k][of] = np.clip(own[k][of] + RATE * pull, -OWN_LIMIT, OWN_LIMIT)
    return np.split(nats, np.cumsum([len(p.has) for p in parts])[:-1])


@dataclass
class Untied:
    """A model that is being fitted: every prediction of a training symbol is made
    without that symbol's own count."""
    model: Model
    left: list[np.ndarray]           # int8 per order and (slot, bit): odds with one such bit less


def untied(code: Code, tables: list[np.ndarray]) -> Untied:
    """What fitting starts from: odds of all counts, and of all but one."""
    weights = np.full((GATES, N_IN), 0.3, np.float32)
    weights[:, -1] = 0
    trust = np.stack([np.ones(LENGTHS), np.linspace(0, 4, LENGTHS)]).astype(np.float32)
    model = Model(code, [odds(t) for t in tables], weights, np.tile(CLASSES, END).astype(np.float32), trust)
    left = []
    for t in tables:
        both = np.empty(len(t), np.int8)
        for bit in (0, 1):
            less = t.copy()
            less[bit::2] = np.maximum(less[bit::2] - 1, 0)
            both[bit::2] = odds(less)
        left.append(both)
    return Untied(model, left)


CLASSES = (np.arange(2 * STEPS + 1, dtype=np.float32) - STEPS) / 2
# Fitting needs sums over all training symbols alone, in tables of fixed size: bits by
# (gate, classes of the odds), bits by cell of the refinement, and bits by (class of
# match length, what the match says, cell of the refinement).
ODDS_STEP = 8                        # stored odds in one class
ODDS_CLASSES = 2 * (127 // ODDS_STEP + 1) + 1
MIXED_CELLS = 2 * GATES * ODDS_CLASSES ** len(ORDERS)
REFINE_CELLS = 2 * END * len(CLASSES)
TRUST_CELLS = 3 * LENGTHS * REFINE_CELLS


class LetterCounter:
    """Symbols of all texts added."""

    def __init__(self):
        self.tables = [np.zeros(END + 1, np.int64)]

    def add(self, texts: list[bytes]):
        self.tables[0][:END] += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=END)
        self.tables[0][END] += len(texts)

    def flush(self):
        pass


class OddsCounter(Counter):
    """Bits of all texts added, by the gate and the classes of the odds that foresaw them."""

    def __init__(self, start: Untied):
        super().__init__(start.model.code)
        self.start, self.tables = start, [np.zeros(MIXED_CELLS, np.int64)]

    def _count(self, run, number):
        size, _, bit, x, gate = inputs(self.start.model, run, self.start.left)
        cell = gate
        for k in range(len(ORDERS)):
            at = np.rint(x[k] * np.float32(SCALE / ODDS_STEP)).astype(np.int64) + ODDS_CLASSES // 2
            cell = cell * ODDS_CLASSES + at
        self.tables[0] += np.bincount(2 * cell + bit.astype(np.int64), np.repeat(number, size),
                                      MIXED_CELLS).astype(np.int64)


class RefineCounter(Counter):
    """Bits of all texts added, by cell of the refinement and by what a match says."""

    def __init__(self, start: Untied):
        super().__init__(start.model.code)
        self.start = start
        self.tables = [np.zeros(REFINE_CELLS, np.int64), np.zeros(TRUST_CELLS, np.int64)]
        self.found: list[tuple] = []         # (runs, symbols that matches say, classes of length)
        self.matches = 0

    def _runs(self, symbols, place):
        run, last = runs(symbols, place)
        has, hope, kind = followed(symbols, place, last)
        self.found.append((run[has], hope, kind))
        self.matches += len(has)
        if self.matches >= FOUND:
            self._match()
        return run

    def flush(self):
        super().flush()
        self._match()

    def _cells(self, run):
        """Bits of every run, cell of the refinement and bit of every step."""
        size, node, bit, x, gate = inputs(self.start.model, run, self.start.left)
        return size, 2 * _cells(node, _mixed(self.start.model.weights, gate, x)) + bit.astype(np.int64)

    def _count(self, run, number):
        size, cell = self._cells(run)
        self.tables[0] += np.bincount(cell, np.repeat(number, size), REFINE_CELLS).astype(np.int64)

    def _match(self):
        if not self.matches:
            self.found = []
            return
        run, hope, kind = (np.concatenate(v) for v in zip(*self.found))
        self.found, self.matches, code = [], 0, self.start.model.code
        keys, place = np.unique(run, return_inverse=True)
        cells = []
        for first in range(0, len(keys), 1 << 14):
            cells.append(self._cells(keys[first:first + (1 << 14)])[1].astype(np.int32))
        cells = np.concatenate(cells)
        length = code.length[(keys & L(511)).astype(np.int64) - 1]
        begins = (np.cumsum(length) - length)[place]
        symbols = (run & L(511)).astype(np.int64) - 1
        for first in range(0, len(run), 1 << 17):
            some = slice(first, first + (1 << 17))
            size, bit, cell, sign = says(code, symbols[some], hope[some], begins[some], cells)
            where = (np.repeat(kind[some] * 3, size) + sign.astype(np.int64) + 1) * REFINE_CELLS + cell
            self.tables[1] += np.bincount(where, minlength=TRUST_CELLS)


def _logistic(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on rows ``x`` seen with so many bits of either
    kind, drawn a little towards ``start``, by Newton's method."""
    w, n = start.astype(np.float64), zeros + ones

    def loss(w):
        z = x @ w
        return ones @ np.logaddexp(0, -z) + zeros @ np.logaddexp(0, z) + 0.5 * ((w - start) ** 2).sum()

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (ones - n * p) - (w - start)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), pull)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then > now:
            break
        w, now = w + step, then
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_weights(start: Untied, counts: np.ndarray) -> None:
    """The weights of every gate, from the counts of an ``OddsCounter``."""
    bits = counts.reshape(-1, 2).astype(np.float64)
    cell = np.flatnonzero(bits.sum(1))
    rest, x = cell, np.full((len(cell), N_IN), 0.25)
    for k in reversed(range(len(ORDERS))):
        rest, at = np.divmod(rest, ODDS_CLASSES)
        x[:, k] = (at - ODDS_CLASSES // 2) * (ODDS_STEP / SCALE)
    weights = start.model.weights
    for gate in range(GATES):
        mine = rest == gate
        if mine.any():
            weights[gate] = _logistic(x[mine], *bits[cell[mine]].T, weights[gate])


def fit_refinement(start: Untied, refined: np.ndarray, matches: np.ndarray) -> None:
    """Refinement and trust in matches, from the counts of a ``RefineCounter``."""
    model = start.model
    zeros, ones = refined.reshape(-1, 2).T
    prior = 1 / (1 + np.exp(-model.refine.astype(np.float64)))
    p = (ones + 30 * prior) / (zeros + ones + 30)
    base = np.tile(CLASSES, END).astype(np.float64)
    model.refine = np.log(p / (1 - p)).astype(np.float32)
    base = 0.5 * (base + model.refine)
    bits = matches.reshape(LENGTHS, 3, -1, 2)
    for kind in range(LENGTHS):
        sign, cell = np.nonzero(bits[kind].any(-1))
        if len(cell):
            x = np.stack([base[cell], sign - 1.0], 1)
            model.trust[:, kind] = _logistic(x, *bits[kind, sign, cell].T.astype(np.float64), model.trust[:, kind])
    model.trust[1] = np.maximum(model.trust[1], 1e-3)


def fit(code: Code, tables: list[np.ndarray], texts: list[bytes]) -> Model:
    """The model of all counts, with weights, trust in matches and refinement fitted on
    ``texts`` (which are part of the counts), in one process."""
    start = untied(code, tables)
    seen = OddsCounter(start)
    seen.add(texts)
    seen.flush()
    fit_weights(start, *seen.tables)
    seen = RefineCounter(start)
    seen.add(texts)
    seen.flush()
    fit_refinement(start, *seen.tables)
    return start.model
