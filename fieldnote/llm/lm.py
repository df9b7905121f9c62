"""Language-model scores by a weighted backoff automaton.

The model is smoothed from n-grams of up to ``order`` tokens; tokens are words and one end per text:

    p(w) = (c(w) + alpha) / (N + alpha (V + 1))
    p(w | h) = max(c(h w) - d, 0) / c(h) + d t(h) / c(h) * p(w | h without its first token)

c counts training tokens, t(h) the kinds of token seen after h, d is the discount.  As an
automaton: a state for each history h of fewer than ``order`` tokens that training holds, the start of a
text among them; an arc with its full weight for every n-gram h w seen; otherwise the failure arc of
h, weight d t(h) / c(h), to the state without the first token of h; the state without history has an
arc for every word.  A text is one run from left to right: at each token failure arcs are followed until
a state has an arc for it, the logarithms of the weights add up, and the arc leads to the longest
state that ends in this token.

Long texts run as lanes of ``LANE`` tokens side by side.  A later lane reads the ``order`` - 1 tokens in front of it
from the state without history and without scoring them, after which it is in the state of the whole run, as no state is longer.

Scale: a block of documents asks the corpus for the counts of its own n-grams, and
builds the part of the automaton in which its texts run, as large as the block.  Words and pairs are asked for at once, then order by
order what is longer, with the kinds after the histories of the order before.  What one block alone can hold is not asked for: an
n-gram of which a part occurs in no other block is counted in whole by its own block, and so are the kinds after a history that
no other block holds; after one seen once there is one kind.  Kinds are sent as bare numbers in the order of the histories asked for
before, whose keys the parts read again.  Every n-gram counts as a kind in the first block that holds it.  All counts are whole;
none is pruned or sampled.  Documents are dealt to blocks by a hash of id and text, so that one id, or null, is spread over all blocks.

Defined results: a null or blank text has the end as its only token; a null id counts as held
out; rows with one id are scored each for itself; without training tokens p(w) is
1 / (V + 1) with V = 0, so that every score is 0; extra columns are ignored; a very long text is scored
whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import blocks as B
from fieldnote.llm import scan
from fieldnote.llm.workers import ready

ALPHA, DISCOUNT, ORDER = 0.1, 0.75, 3
LANE = 1024
# Input bytes of a block: smaller than elsewhere, as a block holds counts and weights of n-grams of every order at once.
BLOCK_BYTES = 4 << 20
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("stage", pa.int32()), ("data", pa.list_(pa.binary()))])
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Block:
    """Tokens of a block's texts, each between a start and an end, and hashes of the n-grams that end at them."""

    def __init__(self, table: pa.Table, order: int, parts: int):
        B.give_back()
        self.ids, self.parts = table["doc_id"], parts
        self.train = table["train"].to_numpy(zero_copy_only=False).astype(bool)
        hashes, lengths = [], []
        for _, _, data, at in B.texts(table):
            starts, ends, first = scan.spans(scan.LOWER[data], at)
            hashes.append(scan.word_hashes(scan.LOWER[data], starts, ends))
            lengths.append(np.diff(first))
        count = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.sizes = count + 2
        self.begin = np.cumsum(self.sizes) - self.sizes
        tokens = np.full(int(self.sizes.sum()), _END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.begin] = inner[self.begin + count + 1] = False
        tokens[inner] = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        tokens[self.begin] = _START
        self.place = np.arange(len(tokens)) - np.repeat(self.begin, self.sizes)
        self.learn = np.repeat(self.train, self.sizes)
        self.grams = [tokens]
        own = scan.mix64(tokens)
        for _ in range(1, order):
            longer = own.copy()
            longer[1:] += self.grams[-1][:-1] * _STEP
            self.grams.append(scan.mix64(longer))

    def levels(self, said: pa.Table | None, passes: int) -> Iterator[_Level]:
        """To be walked once.  The n-grams of each order by what the answers of the first ``passes`` say, as far as they tell what to ask next."""
        heard: dict[int, list[np.ndarray]] = {}
        done, last = 0, None
        for k, gram in enumerate(self.grams):
            # A start counts as a word here, and so as often as there are texts to learn from.
            at = np.flatnonzero(self.place >= k)
            keys = B.Keys([gram[at]], self.parts)
            self.grams[k] = gram = None
            ends = at[keys.first]
            own = np.bincount(keys.inverse, weights=self.learn[at], minlength=len(keys))
            ask = np.ones(len(keys), bool) if k < 2 else last.shared[ends] & last.shared[ends - 1]
            level = _Level(k, at, keys, own, ask)
            if passes < max(k, 1):
                yield level
                if k < 1:
                    continue
                return
            total, flag = own.copy(), np.ones(len(keys), np.uint8)
            n = int(ask.sum())
            if max(k, 1) - 1 not in heard:
                # Only the answers of this order, which are let go after it.
                heard = {max(k, 1) - 1: B.replies(said, max(k, 1), [np.uint64, np.uint8])}
            total[ask], flag[ask] = (x[done : done + n] for x in heard[max(k, 1) - 1])
            level.total, level.wide, new = total, flag > 1, (total > 0) & (flag & 1 > 0)
            level.count, level.shared, level.number = np.zeros(len(self.place)), np.zeros(len(self.place), bool), np.zeros(len(self.place), np.int64)
            level.count[at], level.shared[at], level.number[at] = total[keys.inverse], level.wide[keys.inverse], keys.inverse
            done = n
            if k:
                history = last.number[ends - 1]
                kinds = np.bincount(history, weights=new, minlength=len(last.keys))
                elsewhere = last.wide & (last.total >= 2)
                level.told = np.where(elsewhere, kinds, 0)[last.ask]
                done = int(last.ask.sum())
                kinds = np.where(last.total == 1, 1, kinds)
                if passes > k:
                    heard_of = np.zeros(len(kinds))
                    heard = {k: B.replies(said, k + 1, [np.uint64, np.uint8])}
                    heard_of[last.ask] = heard[k][0][:done]
                    kinds = np.where(elsewhere, heard_of, kinds)
                level.kinds, level.before = kinds[history], last
            yield level
            level.before, last = None, level


class _Level:
    """Distinct n-grams of one order: places, counts in this block and whether to ask for them; then counts, kinds and what is shared with other blocks."""

    def __init__(self, k: int, at: np.ndarray, keys: B.Keys, own: np.ndarray, ask: np.ndarray):
        self.k, self.at, self.keys, self.own, self.ask = k, at, keys, own, ask

    def _asked(self) -> B.Keys:
        """The keys asked for; answers come in their order, which is sorted."""
        return B.Keys([self.keys.columns[0][self.ask]], self.keys.parts)

    def request(self, block: int) -> pa.Table:
        return _moved(self._asked().ask(block, self.own[self.ask].astype(np.uint32)), self.k * self.keys.parts)

    def request_kinds(self, block: int) -> pa.Table:
        """Kinds after the histories in the order in which they were asked for, without the keys."""
        edges, told = self.before._asked().edges, self.told.astype(np.uint32)
        data = [[B.squeeze(told[a:b])] for a, b in zip(edges, edges[1:])]
        n = len(data)
        return _moved(
            pa.table({"part": pa.array(range(n), pa.int32()), "block": pa.array([block] * n, pa.int64()), "data": pa.array(data, pa.list_(pa.binary()))}),
            self.before.k * n,
        )


def _moved(request: pa.Table, by: int) -> pa.Table:
    """A request to the parts ``by`` further on."""
    part = pa.compute.add(request["part"], pa.scalar(by, pa.int32()))
    return request.set_column(0, "part", part)


def traverse(begin: np.ndarray, sizes: np.ndarray, has: np.ndarray, arc: np.ndarray, fail: np.ndarray, first: int, lane: int = LANE) -> np.ndarray:
    """Sum of the weights (logarithms) of the arcs that each text takes.

    A text begins at ``begin`` with its start and has ``sizes`` tokens with it.  has[k, i]: whether the state of the k tokens before
    token i has an arc for it; arc[k, i]: its weight; fail[k, i]: weight of that state's failure arc; first: length of the state of the start."""
    order = len(has)
    lane = max(lane, order)
    n = -(-(sizes - 1) // lane)
    text = np.repeat(np.arange(len(sizes)), n)
    j = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    scored = begin[text] + 1 + lane * j
    stop = np.minimum(scored + lane, (begin + sizes)[text])
    enter = np.where(j > 0, scored - (order - 1), scored)
    longest = np.argsort(enter - stop, kind="stable")
    text, enter, scored, length = text[longest], enter[longest], scored[longest], (stop - enter)[longest]
    state = np.where(j[longest] > 0, 0, first)
    score = np.zeros(len(text))
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    for step, m in enumerate(active.tolist()):
        i, s = enter[:m] + step, state[:m]
        gain = np.zeros(m)
        for k in range(order - 1, 0, -1):
            stuck = (s == k) & ~has[k, i]
            gain += np.where(stuck, fail[k, i], 0.0)
            s = s - stuck
        gain += arc[s, i]
        score[:m] += np.where(i >= scored[:m], gain, 0.0)
        state[:m] = np.where(has[s, i], np.minimum(s + 1, order - 1), 0)
    return np.bincount(text, weights=score, minlength=len(sizes))


def score(docs: DataFrame, alpha: float = ALPHA, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Held out are the documents whose crc32 of the id as text is divisible by 10.  ``order``: longest n-gram, 1 or more."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    n = B.count_for(docs, block_bytes)
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)), F.lit(0))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n).cast("long")).alias("block")
    held = B.bundled(ready(docs).select("doc_id", "text", (rest != 0).alias("train"), block), n)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask_first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = _Block(B.unbundled(table), min(order, 2), n)
        return pa.concat_tables([level.request(key[0].as_py()) for level in b.levels(None, 0)])

    def ask_next(passes: int):
        """The kinds after the histories of the order last answered, and the counts of the next."""

        def ask(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
            b, out = _Block(B.unbundled(table), min(order, passes + 2), n), []
            for level in b.levels(said, passes):
                if level.k == passes:
                    out.append(level.request_kinds(key[0].as_py()))
                elif level.k > passes:
                    out.append(level.request(key[0].as_py()))
            return pa.concat_tables(out)

        return ask

    def totals(columns: list[np.ndarray], whose: np.ndarray, part: int) -> tuple[list, list]:
        """Sum of each key; 1 for the first block that asks and 2 if several do, added; and sum and kinds of a part of words."""
        group, by = B.groups_of(columns[:1])
        total = np.bincount(group, weights=columns[1])
        flag = (2 * (np.bincount(group) > 1))[group].astype(np.uint8)
        flag[by[np.flatnonzero(np.diff(group[by], prepend=-1))]] += 1
        whole = [total.sum(), (total > 0).sum()] if part < n else [0, 0]
        return [total[group].astype(np.uint64), flag], [np.array(whole, np.uint64)]

    def answer_next(passes: int):
        """Counts of the n-grams asked for; for kinds the sum of their numbers by the keys of the earlier request."""

        def reply(key: tuple[pa.Scalar, ...], earlier: pa.Table, table: pa.Table) -> pa.Table:
            B.give_back()
            part = key[0].as_py()
            if not len(table):
                return REPLY.empty_table()
            table, told = table.sort_by("block"), part < passes * n
            rows = table["data"].to_pylist()
            number = [B.expand(r[0 if told else 1], np.uint32) for r in rows]
            keys = [B.expand(r[0], np.uint64, True) for r in (earlier.sort_by("block")["data"].to_pylist() if told else rows)]
            sizes = [len(x) for x in keys]
            (total, flag), _ = totals([np.concatenate(keys), np.concatenate(number)], None, part)
            cuts = np.cumsum([0, *sizes])
            data = [[B.squeeze(total[a:b]), B.squeeze(np.zeros(b - a, np.uint8) if told else flag[a:b])] for a, b in zip(cuts, cuts[1:])]
            m = len(rows)
            return pa.table([table["block"], pa.array([part] * m, pa.int32()), pa.array([passes + 1] * m, pa.int32()), pa.array(data, pa.list_(pa.binary()))], schema=REPLY)

        return reply

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b = _Block(B.unbundled(table), order, n)
        parts = pa.compute.and_(pa.compute.equal(said["stage"], 1), pa.compute.less(said["part"], n))
        tokens, kinds = np.array([B.expand(r[2], np.uint64) for r in said.filter(parts)["data"].to_pylist()]).sum(axis=0).tolist()
        has = np.zeros((order, len(b.place)), bool)
        arc, fail = np.zeros(has.shape), np.zeros(has.shape)
        for level in b.levels(said, order):
            k, at, c = level.k, level.at, level.count
            has[k] = c > 0
            if k == 0:
                texts = int(c[b.begin[0]])
                tokens, kinds = tokens - texts, kinds - (texts > 0)
                p = (c + alpha) / (tokens + alpha * (kinds + 1))
                arc[0] = np.log10(p)
            else:
                h = before[at - 1]
                seen = h > 0
                at, h = at[seen], h[seen]
                backoff = discount * level.kinds[level.keys.inverse[seen]] / h
                p[at] = np.maximum(c[at] - discount, 0) / h + backoff * p[at]
                arc[k, at], fail[k, at] = np.log10(p[at]), np.log10(backoff)
            before = c
        first = int(order > 1 and texts > 0)
        scored = np.ones(len(b.place), bool)
        scored[b.begin] = False
        text = np.repeat(np.arange(len(b.sizes)), b.sizes)[scored]
        of_text = lambda x: np.bincount(text, weights=x[scored], minlength=len(b.sizes))
        return pa.table({
            "doc_id": b.ids, "held_out": pa.array(~b.train), "n_tokens": pa.array((b.sizes - 1).astype(np.int64)),
            "n_known": pa.array(of_text(has[0]).astype(np.int64)), "train_tokens": pa.array(np.full(len(b.sizes), int(tokens), np.int64)),
            "base_score": pa.array(of_text(arc[0])), "score": pa.array(traverse(b.begin, b.sizes, has, arc, fail, first)),
        })

    # Each answer is dealt to the blocks once; the passes after it reuse that exchange.
    back = lambda replies: replies.repartition(n, "block")
    asked = [held.groupBy("block").applyInArrow(ask_first, B.REQUEST)]
    said = back(B.answer(asked[0], 1, [np.uint64, np.uint32], totals, numbered=True))
    for passes in range(1, order):
        asked.append(held.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(ask_next(passes), B.REQUEST))
        earlier = asked[max(passes - 2, 0)]
        said = said.unionByName(back(earlier.groupBy("part").cogroup(asked[-1].groupBy("part")).applyInArrow(answer_next(passes), B.REPLY)))
    return held.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
