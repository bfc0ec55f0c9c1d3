"""An adaptive context-mixing range coder for token ids, over many independent blocks at once.

A block of ids starts from nothing: no state is shared, so any block is decoded alone. Before each id, three orders
predict: order 2 (the last two ids) and order 1 (the last id) each name the id that followed last, with a confidence
that grows as it holds and is cut as it fails; order 0 keeps a cache of recent ids with adaptive counts. The predictions
are mixed to one distribution by adaptive weights, which are learned for each pair of confidences from how often each
order was right; where orders 2 and 1 name the same id their weights add up. An id that none predicts is escaped and
coded uniformly. A 48-bit range coder with 16-bit output words and carries codes the result.

Vectorised over blocks: one numpy step codes the next id of all blocks, so the cost of a step is shared by all of
them. Encoder and decoder run the same model on the same integers. ``IdCoder.java`` is the same coder for executors: what changes
here changes there, too.
"""

from __future__ import annotations

import numpy as np

#: Order-2 and order-1 table sizes, order-0 cache size (powers of two) and its groups, whose sums find a place quickly.
TABLE2, TABLE1, CACHE, GROUP = 1024, 512, 256, 16
_LOW48 = (1 << 48) - 1
_TOP32 = 1 << 32
_ESCAPES = 1 << 16
_STEP = 24  # what a right prediction adds to its weight
_LIMIT = 4000  # weights are halved beyond
_FIELD, _HALF, _ONES = 0xFFFF, 0x7FFF7FFF7FFF7FFF, 0x0001000100010001
_F_HALF, _F_TWELVE = np.float32(0.5), np.float32(12)
_RUNNING = np.triu(np.ones((GROUP, GROUP), np.float32))  # running sums as a product
_START = 2 | 2 << 16 | 8 << 32 | 8 << 48
#: By which orders are right (4: order 2, 2: order 1, 1: order 0): the field of the first of them, or else of the escape, as a shift.
_SHIFT = np.array([48, 32, 16, 16, 0, 0, 0, 0])
#: By a confidence, 4 more if it held: what an entry gains (a right prediction gains confidence, a wrong one loses half of it), and
#: whether its id is lost.
_GAIN = np.array([0, 0, -1, -2, 1, 1, 1, 0], np.int32)
_LOST = np.array([True, True, False, False, False, False, False, False])


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b by division of doubles: exact for a below 2^48 and quotients or divisors of at most 2^16, as a quotient is further from
    the next integer than it is rounded."""
    return (a / b).astype(np.int64)


def _after(entry: np.ndarray, right: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Table entries after an id has come."""
    case = (entry & 3) | right.view(np.uint8) << 2
    new = entry + _GAIN.take(case, mode="clip")
    np.copyto(new, packed, where=_LOST.take(case, mode="clip"))
    return new


def _below(ends: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of each row's 16 ends are at most v: the bytes of two words, summed by a product."""
    words = (ends <= v[:, None]).view(np.uint64) * np.uint64(0x0101010101010101) >> np.uint64(56)
    return (words[:, 0] + words[:, 1]).astype(np.int64)


class Model:
    """Adaptive state of ``lanes`` blocks. Table entries are id * 4 + confidence; four 16-bit weights share a word."""

    def __init__(self, lanes: int):
        self.next2 = np.zeros(lanes * TABLE2, np.int32)
        self.next1 = np.zeros(lanes * TABLE1, np.int32)
        self.cache = np.full(lanes * CACHE, -1, np.int32)
        self.count = np.ones(lanes * CACHE, np.float32)  # whole numbers below 2^24: exact
        self.group = np.full(lanes * GROUP, CACHE // GROUP, np.float32)
        self.weight = np.full(lanes * 16, _START, np.int64)  # of order 2, order 1, order 0 and the escape, by confidences
        self.last = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self._lanes(lanes)

    def _lanes(self, n: int) -> None:
        self.lanes = n
        every = np.arange(n)
        self.base2, self.base1, self.base0, self.base_w, self.base_g = every * TABLE2, every * TABLE1, every * CACHE, every * 16, every * GROUP

    def keep(self, n: int) -> None:
        """Only the first ``n`` lanes go on."""
        for name, size in (("next2", TABLE2), ("next1", TABLE1), ("cache", CACHE), ("count", CACHE), ("group", GROUP), ("weight", 16), ("last", 1), ("last2", 1)):
            setattr(self, name, getattr(self, name)[: n * size])
        self._lanes(n)

    def predict(self) -> None:
        """two, one: the ids that orders 2 and 1 name; ends: the ends of the mixed intervals, four 16-bit fields, of which total is the last."""
        hashed = self.last * 2654435761
        self.at1 = self.base1 + ((hashed >> 11) & (TABLE1 - 1))
        self.at2 = self.base2 + (((self.last2 * 40503 + hashed) >> 13) & (TABLE2 - 1))
        self.p2, self.p1 = self.next2.take(self.at2, mode="clip"), self.next1.take(self.at1, mode="clip")
        self.two, self.one = self.p2 >> 2, self.p1 >> 2
        self.pair = self.base_w + ((self.p2 & 3) << 2 | (self.p1 & 3))
        self.w = self.weight.take(self.pair, mode="clip")
        self.ends = self.w * _ONES  # running sums of the weights, as none takes more than 16 bits
        self.total = self.ends >> 48

    def interval(self, shift: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the intervals at these shifts; agree: order 2's with order 1's weight added up."""
        start, width = (self.ends << 16) >> shift & _FIELD, (self.w >> shift) & _FIELD
        np.copyto(width, (self.ends >> 16) & _FIELD, where=agree)
        return start, width

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return self.base0 + (((ids * 40503) >> 4) & (CACHE - 1))

    def update(self, ids: np.ndarray, slot: np.ndarray, shift: np.ndarray, right2: np.ndarray, right1: np.ndarray, right0: np.ndarray) -> None:
        """shift: of the interval that coded the id; right2, right1, right0: whether each order named it."""
        w = self.w + (_STEP << shift)
        big = np.flatnonzero(self.total > _LIMIT)
        if len(big):
            w[big] = ((w[big] >> 1) & _HALF) + _ONES
        self.weight[self.pair] = w
        packed = (ids << 2).astype(np.int32)
        self.next2[self.at2] = _after(self.p2, right2, packed)
        self.next1[self.at1] = _after(self.p1, right1, packed)
        # A new id takes over its slot and half of the slot's count.
        old = self.count.take(slot, mode="clip")
        new = np.where(right0, old + _STEP, np.floor(old * _F_HALF) + _F_TWELVE)
        self.cache[slot] = ids
        self.count[slot] = new
        at = slot >> 4
        group = self.group.take(at, mode="clip") + (new - old)
        self.group[at] = group
        full = np.flatnonzero(group > 6000)
        if len(full):
            lanes = np.unique(at[full] // GROUP)
            view = self.count.reshape(self.lanes, CACHE)
            view[lanes] = np.floor(view[lanes] * _F_HALF) + 1
            self.group.reshape(self.lanes, GROUP)[lanes] = view[lanes].reshape(len(lanes), GROUP, -1).sum(axis=2)
        self.last2, self.last = self.last, ids

    def group_ends(self, some: np.ndarray) -> np.ndarray:
        """Running sums of the cache's groups in some lanes; whole numbers."""
        return self.group.reshape(self.lanes, GROUP).take(some, axis=0) @ _RUNNING

    def member_ends(self, group: np.ndarray) -> np.ndarray:
        """Running sums of the counts within some groups (numbered over all lanes); whole numbers."""
        return self.count.reshape(-1, CACHE // GROUP).take(group, axis=0) @ _RUNNING


class _Encoder:
    def __init__(self, lanes: int, most_words: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)
        self.out = np.zeros((lanes, most_words), np.uint32)
        self.size = np.zeros(lanes, np.int64)

    def put(self, rows: np.ndarray | None, start: np.ndarray, width: np.ndarray, total: np.ndarray) -> None:
        """Codes [start, start + width) of total in some lanes (None: all of the first ones)."""
        low, rng = (self.low, self.range) if rows is None else (self.low.take(rows), self.range.take(rows))
        step = _quotient(rng, total)
        low = low + step * start
        rng = step * width
        over = np.flatnonzero(low > _LOW48)
        if len(over):
            low[over] &= _LOW48
            at = over if rows is None else rows[over]
            self.out[at, self.size[at] - 1] += 1  # carried on at the end
        move = np.flatnonzero(rng < _TOP32)
        if len(move):
            at = move if rows is None else rows[move]
            size, moved = self.size[at], low[move]
            self.out[at, size] = moved >> 32
            self.size[at] = size + 1
            low[move] = (moved << 16) & _LOW48
            rng[move] <<= 16
        if rows is None:
            self.low, self.range = low, rng
        else:
            self.low[rows], self.range[rows] = low, rng


def _finish(enc_out: np.ndarray, size: np.ndarray, low: np.ndarray) -> list[bytes]:
    for k in (32, 16, 0):
        enc_out[np.arange(len(size)), size] = ((low >> k) & 0xFFFF).astype(np.uint32)
        size = size + 1
    carry = np.zeros(len(size), np.uint32)
    enc_out = enc_out[:, : int(size.max())]
    for k in range(enc_out.shape[1] - 1, -1, -1):
        enc_out[:, k] += carry
        carry = enc_out[:, k] >> 16
        enc_out[:, k] &= 0xFFFF
    words = enc_out.astype(">u2")
    return [words[i, : size[i]].tobytes() for i in range(len(size))]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of blocks of ids (0 to 65535), each by itself."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    most = int(lengths[0])
    ids = np.zeros((most, len(blocks)), np.uint16)
    for k, i in enumerate(order):
        ids[: lengths[k], k] = blocks[i]
    model = Model(len(blocks))
    enc = _Encoder(len(blocks), 3 * most + 8)
    full_size, full_out = enc.size, enc.out
    live = len(blocks)
    done_low = np.zeros(len(blocks), np.int64)
    for t in range(most):
        n = int(np.searchsorted(-lengths, -t, "left"))  # lanes with an id at t
        if n < live:
            done_low[n:live] = enc.low[n:live]
            model.keep(n)
            enc.low, enc.range = enc.low[:n], enc.range[:n]
            live = n
        x = ids[t, :n].astype(np.int64)
        model.predict()
        right2, right1 = model.two == x, model.one == x
        slot = model.slot(x)
        right0 = model.cache.take(slot, mode="clip") == x
        shift = _SHIFT.take(right2.view(np.uint8) << 2 | right1.view(np.uint8) << 1 | right0.view(np.uint8), mode="clip")
        enc.put(None, *model.interval(shift, right2 & right1), model.total)
        rest = np.flatnonzero(shift > 16)
        if len(rest):  # ids of the cache, or escaped ones, which are coded uniformly
            start, width, total = x.take(rest), np.ones(len(rest), np.int64), np.full(len(rest), _ESCAPES)
            hit = np.flatnonzero(right0.take(rest))
            if len(hit):
                some = rest.take(hit)
                at = slot.take(some)
                groups, members, line = model.group_ends(some), model.member_ends(at >> 4), np.arange(0, GROUP * len(some), GROUP)
                own = model.count.take(at)
                start[hit] = groups.take(line + ((at >> 4) & (GROUP - 1))) - members[:, -1] + members.take(line + (at & 15)) - own
                width[hit], total[hit] = own, groups[:, -1]
            enc.put(rest, start, width, total)
        model.update(x, slot, shift, right2, right1, right0)
    done_low[:live] = enc.low[:live]
    coded = _finish(full_out, full_size, done_low)
    out: list[bytes] = [b""] * len(blocks)
    for k, i in enumerate(order):
        out[i] = coded[k] if lengths[k] else b""
    return out


class _Decoder:
    def __init__(self, data: list[bytes]):
        size = [len(d) // 2 for d in data]
        self.words = np.zeros((len(data), max(size, default=0) + 4), np.uint16)
        for i, d in enumerate(data):
            self.words[i, : size[i]] = np.frombuffer(d, ">u2")
        w = self.words[:, :3].astype(np.int64)
        self.code = (w[:, 0] << 32) | (w[:, 1] << 16) | w[:, 2]
        self.range = np.full(len(data), (1 << 48) - 1, np.int64)
        self.at = np.full(len(data), 3)

    def value(self, rows: np.ndarray | None, total: np.ndarray) -> np.ndarray:
        code, rng = (self.code, self.range) if rows is None else (self.code.take(rows), self.range.take(rows))
        self.step = _quotient(rng, total)
        self.now = code
        return np.minimum(_quotient(code, self.step), total - 1)

    def take(self, rows: np.ndarray | None, start: np.ndarray, width: np.ndarray) -> None:
        code = self.now - self.step * start
        rng = self.step * width
        move = np.flatnonzero(rng < _TOP32)
        if len(move):
            at = move if rows is None else rows[move]
            next_ = self.at[at]
            code[move] = ((code[move] << 16) & _LOW48) | self.words[at, np.minimum(next_, self.words.shape[1] - 1)]
            self.at[at] = next_ + 1
            rng[move] <<= 16
        if rows is None:
            self.code, self.range = code, rng
        else:
            self.code[rows], self.range[rows] = code, rng


def decode(data: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of coded blocks of known lengths."""
    if not data:
        return []
    lens = np.array(lengths)
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    most = int(lens[0])
    ids = np.zeros((most, len(data)), np.uint16)
    dec = _Decoder([data[i] for i in order])
    model = Model(len(data))
    live = len(data)
    for t in range(most):
        n = int(np.searchsorted(-lens, -t, "left"))
        if n < live:
            model.keep(n)
            dec.code, dec.range, dec.at = dec.code[:n], dec.range[:n], dec.at[:n]
            live = n
        model.predict()
        v = dec.value(None, model.total)
        agree, end1 = model.two == model.one, (model.ends >> 16) & _FIELD
        by1, by0 = v < end1, v < ((model.ends >> 32) & _FIELD)
        by2 = by1 & ((v < (model.w & _FIELD)) | agree)
        shift = _SHIFT.take(by2.view(np.uint8) << 2 | by1.view(np.uint8) << 1 | by0.view(np.uint8), mode="clip")
        dec.take(None, *model.interval(shift, by2 & agree))
        x = np.where(by2, model.two, model.one).astype(np.int64)
        rest = np.flatnonzero(~by1)
        if len(rest):
            total = np.full(len(rest), _ESCAPES)
            hit = np.flatnonzero(by0.take(rest))
            some = rest.take(hit)
            groups, line = model.group_ends(some), np.arange(0, GROUP * len(some), GROUP)
            total[hit] = groups[:, -1]
            start = dec.value(rest, total)
            found, width = start.copy(), np.ones(len(rest), np.int64)
            if len(hit):
                v = start.take(hit).astype(np.float32)
                g = _below(groups, v)
                members = model.member_ends(model.base_g.take(some) + g)
                before = groups.take(line + g) - members[:, -1]
                k = _below(members, v - before)
                at = model.base0.take(some) + g * 16 + k
                own = model.count.take(at)
                start[hit], width[hit], found[hit] = before + members.take(line + k) - own, own, model.cache.take(at)
            dec.take(rest, start, width)
            x[rest] = found
        ids[t, :n] = x
        slot = model.slot(x)
        model.update(x, slot, shift, model.two == x, model.one == x, model.cache.take(slot, mode="clip") == x)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
    for k, i in enumerate(order):
        out[i] = ids[: lens[k], k].astype(np.uint32)
    return out
