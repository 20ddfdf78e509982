"""Least-cost repair of a conversation's structure.

Rows of a conversation should read ``(s?(ua)+)?`` by the first letters of their
roles. A row may be kept (0), get the role user or assistant (1) or be deleted (2,
as blank and repeated rows must be), an empty row of either role may be inserted
anywhere (5), and a truncated row that stays costs 5 more. Among the cheapest edit
lists the one least in ASCII is taken: D, I, K, R.

A conversation may hold any share of all rows, so it is cut into segments of at
most ``WINDOW`` rows, in order, by position in a table that is sorted over the whole
cluster. A segment is summed up as a 4 x 4 matrix of least costs between states; one
pass over these few rows, last segment first, gives each segment the costs at its
end. Then every segment has its cost DP again, now final, and its optimal arcs. Their
nodes are ranked by the edits that follow: by one, two, four and so on, until no
path is longer. Ranks choose among a node's arcs, and doubled pointers give the
whole path from each of the four states a segment may be entered in. A last pass
in order follows the states, joins the edits and digests the repaired rows.
Memory is bounded but for the edit list, which is one string per conversation.

Rows are ordered by turn (null first), then by role and a hash of the text, so
ties and repeated rows stand together. Null roles and texts are one space. Rows
without a conversation id make up one conversation. Texts of any length are read
whole. An empty table gives no rows. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm.common import numbered, runs, stored
from worktrail.operators.ranking import salted_lookup

WINDOW = 4096
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Where an inserted or rerolled row leads.
START, S, U, A = range(4)
STEP_TO = np.array([U, U, A, U])
#: Costs at the end of a conversation, with the rows that must still be inserted.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
#: Roles by number: where keeping one leads, from each state; -1 is nowhere.
LETTERS = "sua"
KEPT_TO = np.array([[S, -1, -1, -1], [U, U, -1, U], [-1, -1, A, -1], [-1, -1, -1, -1]])
EDITS = "DIKR"
FAR = 1 << 40


# --- faults ------------------------------------------------------------------------

def damaged(turns):
    """The stated damage, by a checksum of each row's place."""
    space = F.lit(" ")
    where = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), space))
    case = F.crc32(where) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (turns.select(
        "conv_id", "turn",
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
        .alias("text"), case.alias("case"))
        .filter("case <> 0")
        .withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1)))
                                      .otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text"))


ORDER = ["conv_id", "turn", "role", "mix", "row"]


def with_faults(turns):
    """All rows, and their order over all conversations with each one's first fault.

    ``at`` numbers the rows in that order (with gaps). Both are written to the
    shared folder; only the first table holds texts.
    """
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("mix"),
                        text.alias("text"))
    rows = stored(numbered(rows, "row"), "turns")
    bare = F.rtrim("text", F.lit(SPACE))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.select(
        *ORDER, said.alias("said"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").isNull().alias("none"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # A conversation's first row of each saying; only sayings said twice are looked up.
    key = ["conv", "none", "said"]
    first = (keyed.groupBy(*key, F.pmod("row", F.lit(64)).alias("part"))
             .agg(F.min(F.struct("turn", "role", "mix", "row")).alias("first"), F.count("*").alias("n"))
             .groupBy(*key).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
             .filter("n > 1").select(*key, F.col("first.row").alias("first")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first") != F.col("row"), "duplicate")
             .when(F.col("open"), "truncated").otherwise(""))
    initial, letter = F.left("role", F.lit(1)), F.lit(-1)
    for number, name in enumerate(LETTERS):
        letter = F.when(initial == name, number).otherwise(letter)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (salted_lookup(keyed, first, key, ["row"], "left")
               .select(*ORDER, fault.alias("fault"), letter.alias("letter"))
               .repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER))
    return rows, stored(numbered(ordered, "at"), "ordered")


# --- segments ----------------------------------------------------------------------

def backward(letter, must, cut, ends):
    """Costs before each row, (rows + 1, states, ...), of rows in order, from those at the end.

    All arrays have the segments of equal length as second axis.
    """
    cost = [ends]
    for t in range(len(letter) - 1, -1, -1):
        after, more = cost[-1], np.where(cut[t], TRUNCATED, 0)[:, None, None]
        to = KEPT_TO[letter[t]]
        kept = np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1) + KEEP + more
        kept = np.where((to < 0)[:, :, None], FAR, kept)
        stay = np.minimum(kept, after[:, STEP_TO] + REROLE + more)
        own = np.minimum(np.where(must[t][:, None, None], FAR, stay), after + DELETE)
        for _ in range(2):  # two insertions lead from any state to any that a row may follow
            own = np.minimum(own, own[:, STEP_TO] + INSERT)
        cost.append(own)
    return np.stack(cost[::-1])


def least_paths(letter, must, cut, first, end, cost, last):
    """Edits and end states of the least path from each state a segment is entered in.

    Nodes are (row, state), with one more row at each segment's end; ``cost`` has
    (rows + segments, 4). A node has an arc per edit, of which those that lose no
    cost count. Ranks of what follows, of doubled length each time, choose among them.
    """
    segments, rows = len(first), len(letter)
    line = np.arange(rows) + np.repeat(np.arange(segments), end - first)  # of nodes
    total, flat = rows + segments, cost.reshape(-1)
    n = 4 * total
    at, state = np.divmod(np.arange(n), 4)
    inner, can = np.zeros(total, bool), np.zeros(total, bool)
    inner[line] = can[line] = True
    can[end + np.arange(segments)] = last  # what follows a segment's last row belongs to the next
    row = np.zeros(total, np.int64)
    row[line] = np.arange(rows)
    inner, can, row = inner[at], can[at], row[at]
    more = np.where(cut[row], TRUNCATED, 0)
    kept, made = KEPT_TO[letter[row], state], STEP_TO[state]
    target = np.stack([(at + 1) * 4 + state, at * 4 + made, (at + 1) * 4 + np.maximum(kept, 0),
                       (at + 1) * 4 + made])
    price = np.stack([np.where(inner, DELETE, FAR), np.where(can, INSERT, FAR),
                      np.where(inner & (kept >= 0) & ~must[row], KEEP + more, FAR),
                      np.where(inner & ~must[row], REROLE + more, FAR)])
    target = np.where(price < FAR, target, 0)
    optimal = (price < FAR) & (price + flat[target] == flat)
    some, edit, nodes = optimal.any(0), np.arange(4)[:, None], np.arange(n)

    rank, steps, longest = np.zeros(n, np.int64), 1, 3 * int((end - first).max()) + 4
    while True:
        arc = np.where(optimal, edit * (rank.max() + 1) + rank[target], FAR).argmin(0)
        following = np.where(some, target[arc, nodes], nodes)
        if steps > longest:
            break
        # Rank anew by the next ``steps`` edits, put together from pairs of pointers.
        code = np.unique(np.where(some, arc + 1, 0), return_inverse=True)[1]
        pointer, length = following, 1
        while length < steps:
            code = np.unique(code * n + code[pointer], return_inverse=True)[1]
            pointer, length = pointer[pointer], 2 * length
        if steps > 1 and (code == rank).all():
            break  # what follows is told apart by fewer edits already
        rank, steps = code, 2 * steps

    path = (4 * (first + np.arange(segments))[:, None] + np.arange(4)).reshape(-1, 1)
    pointer = following
    while some[path[:, -1]].any():
        path = np.concatenate([path, pointer[path]], 1)
        pointer = pointer[pointer]
    letters = np.where(some[path], np.frombuffer(EDITS.encode(), np.uint8)[arc[path]], 0).astype(np.uint8)
    edits = [x[x > 0].tobytes().decode() for x in letters]
    leaves = state[path[:, -1]].tolist()
    return [edits[i:i + 4] for i in range(0, len(edits), 4)], [leaves[i:i + 4] for i in range(0, len(leaves), 4)]


def _windows(batches, columns):
    """Whole windows of rows, as dicts of arrays; the rows come in order of window."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(columns)
        rest = t if rest is None else pa.concat_tables([rest, t])
        if not rest.num_rows:
            continue
        number = rest["at"].to_numpy() // WINDOW
        stop = int(np.searchsorted(number, number[-1]))
        if stop:
            yield rest.slice(0, stop)
            rest = rest.slice(stop).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _cut(table):
    """(conversation column, first row, end) of each segment, and the rows' arrays."""
    at = table["at"].to_numpy()
    conv = table["conv_id"].combine_chunks()
    mark = np.asarray(conv.dictionary_encode(null_encoding="encode").indices)
    new = np.r_[True, (mark[1:] != mark[:-1]) | (at[1:] // WINDOW != at[:-1] // WINDOW)]
    first = np.flatnonzero(new)
    return conv, at, first, np.r_[first[1:], len(at)]


def _arrays(table):
    fault = np.asarray(table["fault"].to_pylist())
    return (table["letter"].to_numpy(), (fault == "blank") | (fault == "duplicate"), fault == "truncated")


def _by_length(first, end):
    """Segments of equal length together: (length, their numbers)."""
    size = end - first
    order = np.argsort(size, kind="stable")
    return [(size[own[0]], own) for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1)]


def costs(table):
    """Per segment: conv_id, seg (its first place), the matrix, end letters, bad pairs."""
    conv, at, first, end = _cut(table)
    letter, must, cut = _arrays(table)
    matrix = np.zeros((len(first), 4, 4), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for size, own in _by_length(first, end):
        rows = first[own] + np.arange(size)[:, None]
        ends = np.broadcast_to(unit, (len(own), 4, 4))
        matrix[own] = backward(letter[rows], must[rows], cut[rows], ends)[0]
    inside = np.r_[bad_pairs(letter[:-1], letter[1:]), False].astype(np.int64)
    inside[end - 1] = 0
    return pa.table({
        "conv_id": conv.take(pa.array(first)), "seg": at[first],
        "matrix": pa.array(list(np.minimum(matrix, FAR).reshape(-1, 16)), pa.list_(pa.int64())),
        "head": letter[first], "tail": letter[end - 1],
        "bad": np.add.reduceat(inside, first)})


def bad_pairs(a, b):
    """Whether neighbours are not su, ua or au."""
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def scan_back(batches):
    """Segments of a conversation, last first: each gets the costs at its end."""
    conv, ends, after = object(), None, -1
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["conv_id"] != conv or ends is None
            if last:
                conv, ends, after = row["conv_id"], AT_END, None
            matrix = np.array(row["matrix"]).reshape(4, 4)
            bad = row["bad"]
            if after is not None:
                bad += int(bad_pairs(np.array(row["tail"]), np.array(after)))
            before = np.minimum((matrix + ends[None, :]).min(1), FAR)
            out.append({"conv_id": row["conv_id"], "seg": row["seg"], "ends": ends.tolist(), "last": last,
                        "bad": bad, "start_cost": int(before[START])})
            ends, after = before, row["head"]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("conv_id", batch.schema.field("conv_id").type), ("seg", pa.int64()),
            ("ends", pa.list_(pa.int64())), ("last", pa.bool_()), ("bad", pa.int64()),
            ("start_cost", pa.int64())]))


def choose(table):
    """Per segment, for each state it may be entered in: the edits and the state it is left in."""
    conv, at, first, end = _cut(table)
    letter, must, cut = _arrays(table)
    # The costs at the end stand on a segment's first row only.
    ends = np.asarray(table["ends"].combine_chunks().take(pa.array(first)).flatten()).reshape(-1, 4)
    last = np.asarray(table["last"].combine_chunks().take(pa.array(first)).to_pylist(), bool)
    cost = np.zeros((len(at) + len(first), 4), np.int64)
    for size, own in _by_length(first, end):
        rows = first[own] + np.arange(size)[:, None]
        found = backward(letter[rows], must[rows], cut[rows], ends[own][:, :, None])[..., 0]
        cost[(first + np.arange(len(first)))[own] + np.arange(size + 1)[:, None]] = found
    edits, leaves = least_paths(letter, must, cut, first, end, cost, last)
    return pa.table({"conv_id": conv.take(pa.array(first)), "seg": at[first],
                     "edits": pa.array(edits, pa.list_(pa.string())),
                     "leaves": pa.array(leaves, pa.list_(pa.int32()))})


# --- whole conversations ------------------------------------------------------------

class Finish:
    """Edits and digest of one conversation, whose segments and rows come in order."""

    def __init__(self):
        self.state, self.output, self.audit, self.todo = START, START, [], iter(())
        self.sha, self.first = hashlib.sha256(), True

    def segment(self, edits, leaves):
        self.audit.append(edits[self.state])
        self.todo = iter(edits[self.state])
        self.state = leaves[self.state]

    def write(self, role, text):
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def made(self):
        """The role that an insertion or rerole gives here."""
        self.output = int(STEP_TO[self.output])
        return "user" if self.output == U else "assistant"

    def row(self, role, text):
        for edit in self.todo:
            if edit == "I":
                self.write(self.made(), "")
                continue
            if edit == "K":
                self.output = int(KEPT_TO[LETTERS.index(role[0]), self.output])
                self.write(role, text)
            elif edit == "R":
                self.write(self.made(), text)
            return

    def end(self):
        for _ in self.todo:  # only insertions are left
            self.write(self.made(), "")
        return "".join(self.audit), self.sha.hexdigest()


def finish(batches):
    conv, own = None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out = []

        def done():
            out.append({"conv_id": conv, **dict(zip(("audit", "repaired_sha256"), own.end(), strict=True))})

        columns = [batch.column(c) for c in ("conv_id", "edits", "leaves", "role", "text")]
        for rows in zip(*(runs(c) for c in columns), strict=True):
            for key, edits, leaves, role, text in zip(*rows, strict=True):
                if own is None or key != conv:
                    if own is not None:
                        done()
                    conv, own = key, Finish()
                if edits is not None:
                    own.segment(edits, leaves)
                else:
                    own.row(role, text)
        yield pa.RecordBatch.from_pylist(out, schema=_told(kind))
    if own is not None:
        out = []
        done()
        yield pa.RecordBatch.from_pylist(out, schema=_told(kind))


def _told(kind):
    return pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _per_window(fn, columns):
    def run(batches):
        for window in _windows(batches, columns):
            yield from fn(window).to_batches()
    return run


def repair(turns):
    """Rows with parts of each conversation's result, from ``turns`` (conv_id, turn, role, text)."""
    texts, rows = with_faults(turns)
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = F.expr(f"at div {WINDOW}")
    narrow = ["conv_id", "at", "letter", "fault"]

    def in_windows(df):
        return df.repartition(parts, window).sortWithinPartitions("at")

    found = in_windows(rows.select(*narrow)).mapInArrow(
        _per_window(costs, narrow), f"conv_id {kind}, seg bigint, matrix array<bigint>, head int, "
                                    "tail int, bad bigint")
    ends = stored(found.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
                  .mapInArrow(scan_back, f"conv_id {kind}, seg bigint, ends array<bigint>, "
                                         "last boolean, bad bigint, start_cost bigint"), "ends")
    known = ends.select(F.col("seg").alias("at"), "ends", "last")
    chosen = in_windows(rows.select(*narrow).join(known, "at", "left")).mapInArrow(
        _per_window(choose, [*narrow, "ends", "last"]),
        f"conv_id {kind}, seg bigint, edits array<string>, leaves array<int>")
    segments = chosen.select(F.col("seg").alias("at"), F.lit(0).alias("kind"), "edits", "leaves")
    # A segment stands before its first row.
    segments = segments.join(rows.select("at", *ORDER), "at").drop("at")
    both = segments.unionByName(texts.withColumn("kind", F.lit(1)), True)
    ended = (both.repartition(parts, "conv_id").sortWithinPartitions(*ORDER, "kind")
             .select("conv_id", "edits", "leaves", "role", "text")
             .mapInArrow(finish, f"conv_id {kind}, audit string, repaired_sha256 string"))

    turn_parts = (rows.groupBy("conv_id", "turn").agg(*[
        F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        .groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
            *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]))
    paid = ends.groupBy("conv_id").agg(F.sum("bad").alias("illegal"),
                                       F.min_by("start_cost", "seg").alias("cost"))
    return turn_parts.unionByName(paid, True).unionByName(ended, True)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(turns, ids=None):
    """One row per conversation, also those of ``ids`` (conv_id) that have no rows left."""
    every = repair(turns)
    if ids is not None:
        every = every.unionByName(ids.select("conv_id").distinct(), True)
    empty = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in NUMBERS],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


def digest(turns):
    return repaired(damaged(turns), turns)
