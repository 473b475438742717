"""The best rows of each of many questions in one pass over scored rows: inside a task, with numpy, a tile at a time."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of questions and rows that are held at once, and what is held of candidates before they are cut.
TILE, HELD = 2_000_000, 1_000_000
#: Share of a tile's pairs from which a term is multiplied as a matrix, and how many such terms there may be.
DENSE, DENSE_TERMS = 0.005, 512


class Best:
    """The first `most` rows of each question by score, then by row, when rows are added in their order."""

    def __init__(self, most: np.ndarray, least: float):
        self.most, self.floor = most, np.full(len(most), least)
        self.parts, self.n = [], 0
        self.row = 0

    def add(self, scores: np.ndarray, nodes: np.ndarray, digits: int | None = None) -> None:
        """scores(question, row) of the next rows; those at or under a question's floor do not count."""
        width = scores.shape[1]
        slack = self.floor if digits is None else self.floor - 2 * 10.0**-digits
        at = np.flatnonzero(scores > slack[:, None].astype(scores.dtype))
        q, d = np.divmod(at, width)
        s = scores.ravel()[at].astype(float)
        if digits is not None:
            s = np.round(s, digits) + 0.0
            ok = s > self.floor[q]
            q, d, s = q[ok], d[ok], s[ok]
        if len(q):
            self.parts.append((q, s, d + self.row, nodes[d]))
            self.n += len(q)
        self.row += width
        if self.n > HELD:
            self.cut()

    def cut(self) -> None:
        """Keeps what is among the best so far, and raises the floors."""
        if not self.parts:
            return
        q, s, row, node = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, -s, q))
        q, s, row, node = q[order], s[order], row[order], node[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.most[q]
        full = nth == self.most[q] - 1
        self.floor[q[full]] = s[full]
        self.parts = [(q[keep], s[keep], row[keep], node[keep])]
        # candidates that are held for good do not count as new ones
        self.n = 0

    def rows(self):
        self.cut()
        return self.parts[0] if self.parts else None


def groups_of(asked: list, shared: str, cases) -> tuple[list, list]:
    """Questions ordered by what they may see, and (first, last, tenants, types) of each such group; None allows all."""
    key = lambda q: (q.get("tenant") or "", q.get("tenant") is not None, tuple(q["types"]) if q.get("types") is not None else (), q.get("types") is not None)
    asked, groups = sorted(asked, key=key), []
    for i, q in enumerate(asked):
        if not i or key(q) != key(asked[i - 1]):
            groups.append([i, i + 1, None if q.get("tenant") is None else {q["tenant"], shared}, None if q.get("types") is None else set(cases(q["types"]))])
        groups[-1][1] = i + 1
    return asked, groups


def hide(scores: np.ndarray, groups: list, columns: dict) -> None:
    """Takes out what a group of questions may not see: columns has tenant_id and doc_type of the rows, where any question asks."""
    for first, last, tenants, types in groups:
        for allowed, name in ((tenants, "tenant_id"), (types, "doc_type")):
            if allowed is not None:
                no = np.flatnonzero(~pc.fill_null(pc.is_in(columns[name], pa.array(sorted(allowed), columns[name].type)), False).to_numpy(zero_copy_only=False))
                scores[first:last, no] = -np.inf


def found(best: Best, asked: list, schema: pa.Schema):
    """The best rows as record batches of query_id, node_id, score."""
    got = best.rows()
    if got is None:
        return
    q, s, _, node = got
    ids = pa.array([x["query_id"] for x in asked], schema.field("query_id").type)
    for i in range(0, len(q), 100_000):
        cut = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[cut])), pa.array(node[cut], schema.field("node_id").type), pa.array(s[cut])], schema=schema)


def by_cosine(asked: list, most: list, least: float | None, groups: list, schema: pa.Schema):
    """A task's work: the best of each question by cosine to six digits, over batches of node_id, embedding in order of node_id."""
    wanted = np.array([q["vector"] for q in asked], float).reshape(len(asked), -1)
    size = np.linalg.norm(wanted, axis=1)
    unit = wanted / np.where(size > 0, size, 1)[:, None]
    width, tile = unit.shape[1], max(1, TILE // max(1, len(asked)))
    columns = [c for c, i in (("tenant_id", 2), ("doc_type", 3)) if any(g[i] is not None for g in groups)]

    def run(batches):
        best = Best(np.array(most), -np.inf if least is None else least)
        for b in batches:
            vectors = b.column("embedding")
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False))
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), width)
            n = np.linalg.norm(x, axis=1)
            ok = n > 0
            b, x = b.filter(pa.array(ok)), x[ok] / n[ok][:, None]
            nodes = b.column("node_id").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), tile):
                scores = unit @ x[i : i + tile].T
                hide(scores, groups, {c: b.column(c).slice(i, tile) for c in columns})
                best.add(scores, nodes[i : i + tile], 6)
        yield from found(best, asked, schema)

    return run


def by_terms(asked: list, most: list, groups: list, terms: int, schema: pa.Schema):
    """A task's work: the best of each question by occurrences of its terms (numbers in q["terms"]), over batches of _t, node_id,
    tf in order of node_id. Terms that many of the questions and rows share are multiplied as matrices, others pair by pair."""
    own = [np.unique(np.array(q["terms"], np.int64)) for q in asked]
    of = np.repeat(np.arange(len(asked)), [len(x) for x in own])
    flat = np.concatenate([*own, np.zeros(0, np.int64)])
    by_term = np.argsort(flat, kind="stable")
    of, askers = of[by_term].astype(np.int64), np.bincount(flat, minlength=terms)
    start = np.concatenate([[0], np.cumsum(askers)])
    common = np.argsort(-askers, kind="stable")[:DENSE_TERMS]
    common = common[askers[common] >= DENSE * len(asked)]
    tile = max(1, TILE // max(1, len(asked)))
    columns = [c for c, i in (("tenant_id", 2), ("doc_type", 3)) if any(g[i] is not None for g in groups)]

    def run(batches):
        best, place = Best(np.array(most), 0.0), np.full(terms, -1)
        has = np.zeros((len(asked), len(common)), np.float32)
        for j, t in enumerate(common):
            has[of[start[t] : start[t + 1]], j] = 1

        def score(t, d, tf, n):
            kind = np.float32 if np.bincount(d, tf).max() < 2**24 else np.float64  # sums are whole numbers
            share = np.bincount(t, minlength=terms)[common] / n * askers[common] / len(asked)
            use = np.flatnonzero(share > DENSE)
            place[common[use]] = np.arange(len(use))
            many = place[t] >= 0
            counts = np.zeros((len(use), n), kind)
            np.add.at(counts, (place[t[many]], d[many]), tf[many].astype(kind))
            place[common[use]] = -1
            scores = has[:, use].astype(kind) @ counts
            t, d, tf = t[~many], d[~many], tf[~many].astype(kind)
            met, flat_scores = np.cumsum(askers[t]), scores.reshape(-1)
            i = 0
            while i < len(t):  # about TILE pairs at once
                j = max(i + 1, int(np.searchsorted(met, (met[i - 1] if i else 0) + TILE, "right")))
                a = askers[t[i:j]]
                inside = np.arange(a.sum()) - np.repeat(np.cumsum(a) - a, a)
                np.add.at(flat_scores, of[np.repeat(start[t[i:j]], a) + inside] * n + np.repeat(d[i:j], a), np.repeat(tf[i:j], a))
                i = j
            return scores

        def whole(table):
            """Scores a table of whole nodes."""
            node = table.column("node_id").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            t, tf = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "tf"))
            d, ends = np.cumsum(np.bincount(first, minlength=len(node))) - 1, [*first, len(node)]
            for i in range(0, len(first), tile):
                j = min(i + tile, len(first))
                rows = slice(ends[i], ends[j])
                scores = score(t[rows].astype(np.int64), d[rows] - i, tf[rows], j - i)
                hide(scores, groups, {c: table.column(c).take(pa.array(first[i:j])) for c in columns})
                best.add(scores, node[first[i:j]])

        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= 500_000:
                table = pa.Table.from_batches(held).combine_chunks()
                last = table.column("node_id")[len(table) - 1]
                upto = pc.index(table.column("node_id"), last).as_py()  # the last node may go on in the next batch
                if upto:
                    whole(table.slice(0, upto))
                held = table.slice(upto).to_batches()
                n = len(table) - upto
        if held:
            whole(pa.Table.from_batches(held).combine_chunks())
        yield from found(best, asked, schema)

    return run
