"""Sums per pair of users from ratings that carry their item's raters: task functions over Arrow batches.

Rows of ratings come sorted by item and leave as one list of raters per item, whose values are packed: each column's
whole numbers, one after the other, in as few bytes as the largest one needs. Rows (user_id, part, w, ..., raters, packed
lists) come sorted by user and part to be summed. Only the rows of some items or users are held at a time, so a task's
memory does not grow with the pairs it makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Entries of rater lists that are summed up at a time, unless one user and part has more.
ENTRIES = 1_000_000
# Ratings whose lists are made at a time, unless one item has more.
RATINGS = 200_000
# Ids in a range below this are counted from the lowest; with a group's number they make one long.
CODES = 1 << 40

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def width_of(low: int, high: int) -> int:
    """Bytes that whole numbers from ``low`` to ``high`` are packed into; only with 8 they may be below 0."""
    return 8 if low < 0 else max(1, -(-int(high).bit_length() // 8))


def _packed(column: pa.ChunkedArray | pa.Array, at: np.ndarray, counts: np.ndarray, width: int | None) -> pa.Array:
    """Lists of ``counts`` values each, taken at ``at``: packed into ``width`` bytes, or as they are."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    if width is None:
        values = column.take(pa.array(at))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    raw = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    raw = raw[at].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((upto * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _unpacked(column: pa.ChunkedArray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The values of all lists, one after the other."""
    data = column.combine_chunks()
    if pa.types.is_list(data.type):
        return pc.list_flatten(data)
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    n = int(counts.sum())
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = int(ends[-1] - ends[0]) // n
        out[:, :width] = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, width)
    values = pa.array(out.view("<i8").ravel())
    return values if kind is None else values.cast(kind)


Widths = dict[str, int | None]


def _list_rows(members: pa.Table, entries: pa.Table, counts: np.ndarray, widths: Widths, always: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Rows (members, raters, packed lists) and the group of each.

    ``entries`` are the lists of all groups end to end, with ``counts`` each; a member (group, place, user_id, parts,
    all_parts, ...) meets those of its group from its place on. A member in several parts gets a row for each, with the
    partners of that part. Groups without members are left out, unless they are ``always`` there.
    """
    group, place, parts = (members[c].to_numpy() for c in ("group", "place", "parts"))
    ends = np.cumsum(counts)
    light = parts == 1
    held = always.copy()
    held[group[light]] = True
    at = [np.flatnonzero(np.repeat(held, counts))]
    held = np.flatnonzero(held)
    groups, sizes, lines = [held], [counts[held]], [np.flatnonzero(light)]
    per_row, part = [np.bincount(group[light], minlength=len(counts))[held]], [np.zeros(int(light.sum()), np.int32)]
    for i in np.flatnonzero(~light):
        g, n = group[i], int(parts[i])
        mine = np.arange(ends[g] - counts[g] + place[i], ends[g])
        of = pd.util.hash_array(np.asarray(entries["other_id"].take(pa.array(mine)).to_numpy())) % np.uint64(n)
        for p in range(n):
            some = mine[of == p]
            if len(some):
                for x, new in ((at, some), (groups, [g]), (sizes, [len(some)]), (lines, [i]), (per_row, [1]), (part, np.array([p], np.int32))):
                    x.append(new)
    at, groups, sizes, lines = (np.concatenate(x).astype(np.int64) for x in (at, groups, sizes, lines))
    own = [c for c in members.column_names if c not in ("group", "place", "user_id", "parts", "all_parts")]
    fields = members.select(["user_id", "all_parts", *own]).take(pa.array(lines))
    columns = {c: fields[c].combine_chunks() for c in fields.column_names}
    columns |= {"part": pa.array(np.concatenate(part)), "place": pa.array(np.where(light[lines], place[lines], 0).astype(np.int32))}
    upto = np.concatenate([[0], np.cumsum(np.concatenate(per_row))])
    one = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    out = {"members": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), one), "raters": pa.array(sizes.astype(np.int32))}
    out |= {c: _packed(entries[c], at, sizes, widths[c]) for c in entries.column_names}
    return pa.table(out), groups


def item_lists(own: list[str], others: dict[str, str], widths: Widths, half: bool) -> Task:
    """A task that makes the list of each item and piece from its ratings (item_id, piece, pieces, user_id, parts, mine, ...),
    sorted by item, piece and user: (item_id, piece, pieces, members, raters, packed lists).

    ``others`` names the column of each list. Its entries are the ratings whose weight in the list is not 0, its members
    those that are ``mine``. With ``half`` a member meets only the entries after its own.
    Items of several pieces are left to ``meetings``, and only listed here.
    """

    def lists(rows: pa.Table) -> pa.Table:
        starts = _firsts(rows, ["item_id", "piece"])
        group, heads = np.cumsum(starts) - 1, rows.filter(pa.array(starts))
        listed = rows[others["w_other"]].to_numpy() != 0 if others["w_other"] != "w" else np.ones(len(rows), bool)
        counts = np.bincount(group[listed], minlength=len(heads))
        whole = heads["pieces"].to_numpy()[group] == 1
        upto = np.cumsum(listed) - np.concatenate([[0], np.cumsum(counts)])[group]
        place = np.where(whole, upto, 0) if half else np.zeros(len(rows), np.int64)
        left = counts[group] - place - (0 if half else listed)
        mine = rows["mine"].to_numpy() & (~whole | (left > 0))
        # of items of several pieces, users are told apart by part where the lists meet
        parts = np.where(whole, rows["parts"].to_numpy(), 1)
        members = pa.table({"group": group, "place": place, "parts": parts, "all_parts": rows["parts"], **{c: rows[c] for c in ("user_id", *own)}})
        entries = rows.filter(pa.array(listed))
        entries = pa.table({c: entries[x] for c, x in others.items()})
        out, groups = _list_rows(members.filter(pa.array(mine)), entries, counts, widths, heads["pieces"].to_numpy() > 1)
        heads = heads.select(["item_id", "piece", "pieces"]).take(pa.array(groups))
        for i, c in enumerate(heads.column_names):
            out = out.add_column(i, c, heads[c])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["item_id", "piece"], lambda x: np.ones(len(x), int), RATINGS):
            yield from lists(rows).to_batches()

    return run


def meetings(own: list[str], names: list[str], widths: Widths, half: bool) -> Task:
    """A task that brings members of one piece of an item and the list of another one (members, raters, packed lists) into
    the form that ``item_lists`` gives for items of one piece."""

    def meet(rows: pa.Table) -> pa.Table:
        counts = rows["raters"].to_numpy().astype(np.int64)
        flat = pc.list_flatten(rows["members"].combine_chunks())
        members = pa.Table.from_struct_array(flat)
        group = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["members"]).to_numpy())
        kind = members.schema.field("user_id").type
        entries = pa.table({c: _unpacked(rows[c], counts, kind if c == "other_id" else None) for c in names})
        users, ids = members["user_id"].to_numpy(), entries["other_id"].to_numpy()
        place, upto = np.zeros(len(users), np.int64), np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(group, np.arange(len(rows) + 1))
        for g in range(len(rows) if half else 0):
            at = slice(first[g], first[g + 1])
            place[at] = np.searchsorted(ids[upto[g] : upto[g + 1]], users[at], "right")
        members = pa.table({"group": group, "place": place, "parts": members["all_parts"], **{c: members[c] for c in ("all_parts", "user_id", *own)}})
        return _list_rows(members.filter(pa.array(counts[group] > place)), entries, counts, widths, np.zeros(len(rows), bool))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = 0, np.cumsum(batch.column("raters").to_numpy().astype(np.int64) + pc.list_value_length(batch.column("members")).to_numpy())
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + RATINGS, "right")))
                yield from meet(pa.Table.from_batches([batch.slice(at, to - at)])).to_batches()
                at = to

    return run


def per_pair(own: list[str], least: list[str], finish: Callable[[pa.Table, pa.Table], pa.Table]) -> Task:
    """A task that sums w x w_other per user, part and other user, as ``dot``.

    The columns ``own`` of a user, and the same of the other as ``<name>_other``, are constant and
    carried along; of those in ``least`` each pair has its minimum. ``finish`` takes the pairs
    (group, other_id, dot, ...) and the groups (user_id, part) and makes the rows that go on.
    """

    def summed(rows: pa.Table) -> pa.Table:
        others = _others(rows)
        line = np.repeat(np.arange(len(rows)), _lengths(rows))
        other, user = _codes(others["other_id"], rows["user_id"])
        apart = np.flatnonzero(user[line] != other)
        line, other = line[apart], other[apart]
        starts = _firsts(rows, ["user_id", "part"])
        group = np.cumsum(starts) - 1
        # entries of a pair come to lie together
        key = group[line] * (int(other.max(initial=0)) + 1) + other
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        line, spot = line[order], apart[order]

        def least_of(values: np.ndarray) -> pa.Array:
            return pa.array(np.minimum.reduceat(values, first) if len(first) else values)

        product = rows["w"].to_numpy()[line] * others["w_other"].to_numpy()[spot]
        head = group[line[first]]
        pairs = {"group": head, "other_id": others["other_id"].take(pa.array(spot[first])), "dot": np.add.reduceat(product, first) if len(first) else product}
        groups = rows.filter(pa.array(starts))
        pairs |= {c: groups[c].to_numpy()[head] for c in own} | {f"{c}_other": others[f"{c}_other"].to_numpy()[spot[first]] for c in own}
        for c in least:
            pairs |= {c: least_of(rows[c].to_numpy()[line]), f"{c}_other": least_of(others[f"{c}_other"].to_numpy()[spot])}
        return finish(pa.table(pairs), groups.select(["user_id", "part"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["user_id", "part"], _lengths, ENTRIES):
            yield from summed(rows).to_batches()

    return run


def all_pairs(pairs: pa.Table, groups: pa.Table) -> pa.Table:
    return _named(pairs, groups)


def nearest_pairs(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k of every user and part: (user_id, part, other_id, cos)."""

    def finish(pairs: pa.Table, groups: pa.Table) -> pa.Table:
        cos = _cosines(pairs)
        best = np.flatnonzero(_among_first(pairs["group"].to_numpy(), cos, k))
        pairs = pairs.take(pa.array(best)).append_column("cos", pa.array(cos[best]))
        pairs = pairs.sort_by([("group", "ascending"), ("cos", "descending"), ("other_id", "ascending")])
        first = pa.array(_ranks(pairs["group"].to_numpy()) < k)
        return _named(pairs.filter(first), groups).select(["user_id", "part", "other_id", "cos"])

    return finish


def live_pairs(k: int, slack: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs whose cosine can still reach the k-th best of the user's part, with what ``hot_n`` can add."""

    def finish(pairs: pa.Table, groups: pa.Table) -> pa.Table:
        group, cos = pairs["group"].to_numpy(), _cosines(pairs)
        best = np.flatnonzero(_among_first(group, cos, k))
        best = best[np.lexsort((-cos[best], group[best]))]
        kth = best[_ranks(group[best]) == k - 1]
        floor = np.zeros(len(groups))
        floor[group[kth]] = cos[kth]
        hot_both = _product(pairs, "hot_n")
        reach = (_floats(pairs["dot"]) + np.sqrt(hot_both)) / np.sqrt(_product(pairs, "n")) * (1 + slack)
        rows = pairs.append_column("add", pa.array(hot_both > 0)).filter(pa.array(reach >= floor[group]))
        return _named(rows, groups).select(["user_id", "other_id", "dot", "n", "n_other", "add"])

    return finish


def reaching_pairs(floor: float, slack: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs that can reach the cosine ``floor``, and whether anything may be missing in ``dot``.

    ``dot`` lacks the common items that lie behind the listed part of one of both rows. These come
    after the pair's last listed item, so the other row has at most its least ``tail`` there.
    """

    def finish(pairs: pa.Table, groups: pa.Table) -> pa.Table:
        here = _floats(pairs["unlisted"]) * _floats(pairs["tail_other"])
        there = _floats(pairs["tail"]) * _floats(pairs["unlisted_other"])
        missing = np.sqrt(np.maximum(here, there))
        reach = (_floats(pairs["dot"]) + missing) / np.sqrt(_product(pairs, "n")) * (1 + slack)
        rows = pairs.append_column("open", pa.array(missing > 0)).filter(pa.array(reach >= floor * (1 - slack)))
        return _named(rows, groups).select(["user_id", "other_id", "dot", "n", "n_other", "size", "size_other", "open"])

    return finish


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(float)


def _product(pairs: pa.Table, name: str) -> np.ndarray:
    return _floats(pairs[name]) * _floats(pairs[f"{name}_other"])


def _named(pairs: pa.Table, groups: pa.Table) -> pa.Table:
    """Pairs with user_id and part in place of the number of their group."""
    for name in ("part", "user_id"):
        pairs = pairs.add_column(0, name, groups[name].take(pairs["group"]))
    return pairs.drop_columns(["group"])


def _lengths(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return rows["raters"].to_numpy().astype(np.int64)


def _others(rows: pa.Table) -> pa.Table:
    """The entries of all lists, one after the other."""
    kind, counts = rows.schema.field("user_id").type, _lengths(rows)
    names = [c for c in rows.column_names if c.endswith("_other")]
    return pa.table({"other_id": _unpacked(rows["other_id"], counts, kind)} | {c: _unpacked(rows[c], counts) for c in names})


def _cosines(pairs: pa.Table) -> np.ndarray:
    return _floats(pairs["dot"]) / np.sqrt(_product(pairs, "n"))


def _ranks(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0, of rows sorted by group."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _among_first(group: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Whether a row has one of the k highest cosines of its group, ties included, of rows sorted by group.

    Each round takes the highest of every group, which is cheaper than to sort the rows.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(group)))
    left, taken = cos.copy(), np.zeros(len(group), bool)
    for _ in range(k if len(group) else 0):
        highest = left == np.repeat(np.maximum.reduceat(left, starts), sizes)
        taken |= highest
        left[highest] = -np.inf
    return taken


def _codes(others: pa.ChunkedArray, users: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Small whole numbers in place of ids, from 0, equal where these are; -1 for users who are nobody's other."""
    others, users = others.combine_chunks(), users.combine_chunks()
    if pa.types.is_integer(others.type) and len(others):
        ids = others.to_numpy().astype(np.int64)
        low, high = int(ids.min()), int(ids.max())
        if high - low < CODES:
            mine = users.to_numpy().astype(np.int64)
            return ids - low, np.where((mine < low) | (mine > high), -1, mine - low)
    found = others.dictionary_encode()
    mine = pc.fill_null(pc.index_in(users, found.dictionary), -1)
    return found.indices.to_numpy().astype(np.int64), mine.to_numpy().astype(np.int64)


def _firsts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row is the first with its keys, of rows sorted by these."""
    first = np.ones(len(rows), bool)
    columns = [rows[c].combine_chunks() for c in keys]
    while any(pa.types.is_struct(x.type) for x in columns):
        columns = [y for x in columns for y in (x.flatten() if pa.types.is_struct(x.type) else [x])]
    if len(rows) > 1:
        first[1:] = np.any([pc.not_equal(x.slice(1), x.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False) for x in columns], axis=0)
    return first


def _whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], weights: Callable[[pa.Table | pa.RecordBatch], np.ndarray], limit: int
) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables of whole groups and about ``limit`` by weight."""
    held: list[pa.RecordBatch] = []
    entries = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        entries += int(weights(batch).sum())
        if entries < limit:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        borders = np.append(np.flatnonzero(_firsts(rows, keys)), len(rows))
        upto = np.concatenate([[0], np.cumsum(weights(rows))])[borders]
        # the last group may go on in the next batch
        at, last = 0, len(borders) - 2
        while at < last:
            to = min(max(int(np.searchsorted(upto, upto[at] + limit, "right")) - 1, at + 1), last)
            yield rows.slice(borders[at], borders[to] - borders[at])
            at = to
        rest = rows.slice(borders[last])
        held, entries = rest.to_batches(), int(upto[-1] - upto[last])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
