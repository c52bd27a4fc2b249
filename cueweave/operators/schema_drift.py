"""Schemas that drift between the files of a feed (problem 1).

Tagged-union inference: every document yields the set of its leaf paths, each tagged with its JSON type. Tagged paths
are fused per file, which keeps all alternative types of a path, and the fused schemas of neighbouring files are compared. Renames are proven by values: documents that occur in both files are recognised by the values that have not
changed, common ones included, and an old and a new path are one field if all these documents agree on them.

Payloads are parsed once, into one row per document: the hashes of its paths and of its values. A tagged path is spelled
out once per task and file, so that schemas are read from few rows. What is shuffled for the proof are hashes. All
documents of a file meet all of the file before it, in tiles of bounded size; no key is a file alone.

Defined results: null, empty, broken and non-object payloads count for nothing; explicit JSON nulls are absent values;
repeated lines are one document; an empty table gives an empty result; extra columns are ignored; a path whose types
are mixed within a file has all of them, joined by "|" in reports.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.runtime import cut_lineage

FILE_KEYS = ("feed", "file_seq")
#: More distinct fields than this are no schema but data used as keys; the wide table is then refused.
MAX_FIELDS = 2000

_LEAVES = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("file_seq", T.IntegerType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("doc", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("vh", T.LongType()),
])


def kind_of(value: object) -> str:
    """JSON type of a leaf: string, number, boolean or array."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array"


def leaves_of(payload: str | None) -> list[tuple[str, object]] | None:
    """(dotted path, value) of all leaves that are not null; None if the payload is not a JSON object."""
    if not payload:
        return None
    try:
        root = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    out, stack = [], [("", root)]
    while stack:
        prefix, node = stack.pop()
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                stack.append((path, value))
            elif value is not None:
                out.append((path, value))
    return out


def _canonical(value: object) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def _hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _clean(text: str) -> str:
    """JSON escapes can make lone surrogates, which no column can hold."""
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def _explode_batches(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = (), bare: bool = False) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feed", pa.string()), ("file_seq", pa.int32()), ("file_id", pa.int64()), ("line_no", pa.int32()), ("doc", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("vh", pa.int64()), *((c, pa.string()) for c in extra)])
    for batch in batches:
        rows, doc, path, kind, text, vh = [], [], [], [], [], []
        for i, payload in enumerate(batch.column("payload").to_pylist()):
            leaves = leaves_of(payload)
            if leaves is None:
                continue
            own = []
            for p, v in leaves:
                k, c = kind_of(v), _canonical(v)
                own.append((_clean(p), k, _clean(c), _hash64(f"{k}:{c}")))
            own.sort()
            d = _hash64("\x00".join(f"{p}\x01{h}" for p, _, _, h in own))
            for p, k, c, h in own or ([(None, None, None, None)] if bare else []):
                rows.append(i)
                doc.append(d)
                path.append(p)
                kind.append(k)
                text.append(c)
                vh.append(h)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).cast(schema.field(c).type).take(take) for c in ("feed", "file_seq", "file_id", "line_no")), pa.array(doc, pa.int64()), pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(vh, pa.int64()), *(batch.column(c).take(take) for c in extra)],
            schema=schema,
        )


_DOCUMENTS = T.StructType([
    *_LEAVES.fields[:2], T.StructField("doc", T.LongType()), T.StructField("phs", T.ArrayType(T.LongType())), T.StructField("vhs", T.ArrayType(T.LongType())),
    T.StructField("fields", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())]))),
])


def _path_hash(path: str) -> int:
    """The hash of a path as Spark's xxhash64 has it."""
    h = xxhash.xxh64_intdigest(_clean(path).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


_quoted = json.encoder.encode_basestring


def _as_sql(value: object) -> str:
    """A value as the text that documents are put in order by."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        try:
            return repr(float(value))
        except OverflowError:
            return str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _mark(leaves: list[tuple[str, str, object]]) -> int:
    """The first 64 bits of the MD5 of a document's sorted leaves (path, kind, value), in the order of its hexadecimal form."""
    text = "\x02".join(f"{path}\x01{kind}\x01{_as_sql(value)}" for path, kind, value in leaves)
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8]) - (1 << 63)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spelled: set[tuple] = set()
    shapes: dict[tuple, list[int]] = {}
    spell = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())]))
    for batch in batches:
        if len(spelled) > 500_000:
            spelled.clear()
        if len(shapes) > 100_000:
            shapes.clear()
        rows, doc, phs, vhs, fields = [], [], [], [], []
        files = zip(batch.column("feed").to_pylist(), batch.column("file_seq").to_pylist(), batch.column("payload").to_pylist())
        for i, (feed, seq, payload) in enumerate(files):
            leaves = leaves_of(payload)
            if not leaves:
                continue
            leaves.sort(key=lambda leaf: leaf[0])
            own = tuple(path for path, _ in leaves)
            paths = shapes.get(own)
            if paths is None:
                paths = shapes[own] = [_path_hash(p) for p in own]
            values, new, typed = [], [], []
            for path, value in leaves:
                kind = kind_of(value)
                typed.append((path, kind, value))
                values.append(_hash64(f"{kind}:{_canonical(value)}"))
                if (feed, seq, path, kind) not in spelled:
                    spelled.add((feed, seq, path, kind))
                    new.append({"path": _clean(path), "kind": kind})
            rows.append(i)
            doc.append(_mark(typed))
            phs.append(paths)
            vhs.append(values)
            fields.append(new or None)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("feed").take(take), batch.column("file_seq").take(take), pa.array(doc, pa.int64()), pa.array(phs, pa.list_(pa.int64())), pa.array(vhs, pa.list_(pa.int64())), pa.array(fields, spell)], names=_DOCUMENTS.names)


def parsed_documents(raw: DataFrame) -> DataFrame:
    """feed, file_seq, doc, phs, vhs, fields: one row per valid document with fields; the hash of its content, those of its paths and of their values, and the tagged paths that no row before has in its task and file."""
    need = raw.select("feed", F.col("file_seq").cast("int"), F.col("payload").cast("string")).where("payload is not null")
    return need.mapInArrow(_parse_batches, _DOCUMENTS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by file and tagged path, counted batch by batch."""
    for batch in batches:
        count: Counter[tuple] = Counter()
        for feed, seq, payload in zip(batch.column("feed").to_pylist(), batch.column("file_seq").to_pylist(), batch.column("payload").to_pylist()):
            count.update((feed, seq, _clean(path), kind_of(value)) for path, value in leaves_of(payload) or ())
        columns = list(zip(*count)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:]), pa.array(list(count.values()), pa.int64())], names=["feed", "file_seq", "path", "kind", "n"])


def _typed_leaves(raw: DataFrame) -> DataFrame:
    """The leaves with the doc_type of their document; a document without leaves has one row, whose path is null."""
    need = raw.select("feed", F.col("file_seq").cast("int"), F.col("file_id").cast("long"), F.col("line_no").cast("int"), F.col("payload").cast("string"), F.col("doc_type").cast("string"))
    explode = lambda batches: _explode_batches(batches, ("doc_type",), bare=True)
    return need.where("payload is not null").mapInArrow(explode, T.StructType([*_LEAVES.fields, T.StructField("doc_type", T.StringType())]))


def fused_schemas(docs: DataFrame) -> DataFrame:
    """feed, file_seq, path, kinds (sorted alternatives): the tagged union of each file's parsed documents."""
    one = docs.where("fields is not null").select(*FILE_KEYS, F.explode("fields").alias("f")).select(*FILE_KEYS, "f.path", "f.kind")
    return one.groupBy(*FILE_KEYS, "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _files(raw: DataFrame) -> DataFrame:
    return raw.groupBy("feed", F.col("file_seq").cast("int").alias("file_seq")).agg(F.min(F.col("file_id").cast("long")).alias("file_id"))


def _changes(raw: DataFrame, schemas: DataFrame) -> DataFrame:
    """feed, file_seq, file_id, path, new_kinds, old_kinds (null where absent) of every path that differs from the file before."""
    files = _files(raw)
    before = files.select("feed", (F.col("file_seq") + 1).alias("file_seq"))
    pairs = files.join(before, [*FILE_KEYS])
    new = schemas.select(*FILE_KEYS, "path", F.col("kinds").alias("new_kinds"), F.lit(None).cast("array<string>").alias("old_kinds"))
    old = schemas.select("feed", (F.col("file_seq") + 1).alias("file_seq"), "path", F.lit(None).cast("array<string>").alias("new_kinds"), F.col("kinds").alias("old_kinds"))
    both = new.unionByName(old).groupBy(*FILE_KEYS, "path").agg(F.max("new_kinds").alias("new_kinds"), F.max("old_kinds").alias("old_kinds"))
    return both.where(~F.col("new_kinds").eqNullSafe(F.col("old_kinds"))).join(pairs, [*FILE_KEYS])


#: A small table that documents are joined with is broadcast up to so many fields; beyond, it is repeated under _SALTS keys, so that the documents of a file spread over as many tasks.
MAX_SENT = 500_000
_SALTS = 32


def _join_small(big: DataFrame, small: DataFrame, keys: list[str], fields: int, salt: str) -> DataFrame:
    """Inner join with a small table of so many fields; salt is a column of big that differs within a key."""
    if fields <= MAX_SENT:
        return big.join(F.broadcast(small), keys)
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.col(salt), F.lit(_SALTS)).cast("int")).join(spread, [*keys, "salt"]).drop("salt")


def _ends() -> Column:
    """A file is the new one of its own comparison and the old one of the next."""
    return F.explode(F.array(F.struct(F.col("file_seq").alias("at"), F.lit(False).alias("old")), F.struct((F.col("file_seq") + 1).alias("at"), F.lit(True).alias("old")))).alias("e")


def _roles(docs: DataFrame, changes: DataFrame) -> tuple[DataFrame, int]:
    """(feed, file_seq, changed, gone, come, old_tiles, new_tiles; number of fields) of each comparison that has removed and added fields: hashes of the paths that differ, of those that only the old or the new file has, and into how many tiles the documents of either file go. Of the size of the schemas."""
    gone, come, path = F.col("new_kinds").isNull(), F.col("old_kinds").isNull(), F.xxhash64("path")
    open_pairs = changes.groupBy(*FILE_KEYS).agg(F.collect_list(path).alias("changed"), F.collect_list(F.when(gone, path)).alias("gone"), F.collect_list(F.when(come, path)).alias("come")).where("size(gone) > 0 and size(come) > 0")
    tiles = docs.groupBy(*FILE_KEYS).agg(F.ceil(F.count("*") / TILE).cast("bigint").alias("new_tiles"))
    before = tiles.select("feed", (F.col("file_seq") + 1).alias("file_seq"), F.col("new_tiles").alias("old_tiles"))
    roles = cut_lineage(open_pairs.join(tiles, [*FILE_KEYS]).join(before, [*FILE_KEYS]))
    return roles, roles.agg(F.sum(F.size("changed"))).first()[0] or 0


#: Documents of either side that meet in one task: a comparison goes in tiles of about so many by so many.
TILE = 4096
#: Documents of the old side whose votes are held at once, by all of the new side of a tile.
_STRIP = 128

_MOVED = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("v", T.LongType())]))
_BEST = T.StructType([
    *_LEAVES.fields[:2], T.StructField("old", T.BooleanType()), T.StructField("doc", T.LongType()), T.StructField("other", T.LongType()), T.StructField("votes", T.IntegerType()),
    T.StructField("moved_a", _MOVED), T.StructField("moved_b", _MOVED),
])


class _Side:
    """The documents of one side of a tile, each once and in order: their marks, and the row, path and value of each leaf."""

    def __init__(self, pieces: list[tuple[np.ndarray, ...]]) -> None:
        doc, sizes, path, value = (np.concatenate(x) for x in zip(*pieces))
        self.doc, first = np.unique(doc, return_index=True)
        row = np.full(len(doc), -1)
        row[first] = np.arange(len(first))
        row = np.repeat(row, sizes)
        own = row >= 0
        self.row, self.path, self.value = row[own], path[own], value[own]

    def table(self, paths: np.ndarray, values: np.ndarray, absent: int) -> np.ndarray:
        """A row per path and a column per document: the number of the value."""
        own = np.isin(self.path, paths)
        out = np.full((len(paths), len(self.doc)), absent, np.int32)
        out[np.searchsorted(paths, self.path[own]), self.row[own]] = np.searchsorted(values, self.value[own])
        return out

    def moved(self, only: np.ndarray, rows: np.ndarray) -> dict[int, list[dict]]:
        """The leaves under the given paths, by row."""
        out: dict[int, list[dict]] = {int(r): [] for r in rows}
        own = np.isin(self.path, only) & np.isin(self.row, rows)
        for r, p, v in zip(self.row[own].tolist(), self.path[own].tolist(), self.value[own].tolist()):
            out[r].append({"p": p, "v": v})
        return out


def _best_of(a: _Side, b: _Side, changed: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each document of either side the first of the other side with most votes, and those votes (0: none).

    Votes are the unchanged fields on which two documents agree: at least two, and nine tenths of those that both have.
    """
    paths = np.setdiff1d(np.intersect1d(a.path, b.path), changed)
    values = np.unique(np.concatenate([a.value, b.value]))
    left, right = a.table(paths, values, -1), b.table(paths, values, -2)
    shown = (right >= 0).astype(np.float32)
    to_b, best_a = np.zeros(len(a.doc), np.int64), np.zeros(len(a.doc), np.int32)
    to_a, best_b = np.zeros(len(b.doc), np.int64), np.zeros(len(b.doc), np.int32)
    for at in range(0, len(a.doc), _STRIP):
        strip = left[:, at : at + _STRIP]
        votes = np.zeros((strip.shape[1], len(b.doc)), np.int32)
        for x, y in zip(strip, right):
            votes += x[:, None] == y
        both = (strip >= 0).astype(np.float32).T @ shown
        votes[(votes < 2) | (10 * votes < 9 * both)] = 0
        to_b[at : at + _STRIP], best_a[at : at + _STRIP] = votes.argmax(1), votes.max(1)
        most = votes.max(0)
        more = most > best_b
        to_a[more], best_b[more] = at + votes.argmax(0)[more], most[more]
    return to_b, best_a, to_a, best_b


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_tiles` in order to the best partner of each document in its tile."""
    schema = to_arrow_schema(_BEST)
    held: list[list[tuple[np.ndarray, ...]]] = [[], [], [], []]
    names: tuple = ()
    out: list[tuple] = []

    def close() -> None:
        if not all(held):
            return
        (_, _, changed, gone), come = held[0][0], held[1][0][3]
        a, b = _Side(held[2]), _Side(held[3])
        to_b, best_a, to_a, best_b = _best_of(a, b, changed)
        found = np.flatnonzero(best_a)
        moved_a, moved_b = a.moved(gone, found), b.moved(come, to_b[found])
        out.extend((*names, True, int(a.doc[i]), int(b.doc[to_b[i]]), int(best_a[i]), moved_a[i], moved_b[int(to_b[i])]) for i in found.tolist())
        out.extend((*names, False, int(b.doc[j]), int(a.doc[to_a[j]]), int(best_b[j]), None, None) for j in np.flatnonzero(best_b).tolist())

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [() for _ in schema]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, role, doc = (batch.column(c).to_numpy() for c in ("tile", "role", "doc"))
        lists = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (batch.column("phs"), batch.column("vhs"))]
        edges = np.flatnonzero((np.diff(tile) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(tile)]):
            if tile[lo] != now:
                close()
                now, held = tile[lo], [[], [], [], []]
                if len(out) >= 10_000:
                    yield flush()
            (p_at, p), (v_at, v) = lists
            if role[lo] == 0:
                names = batch.column("feed")[lo].as_py(), batch.column("file_seq")[lo].as_py()
            held[role[lo]].append((doc[lo:hi], np.diff(p_at[lo : hi + 1]), p[p_at[lo] : p_at[hi]], v[v_at[lo] : v_at[hi]]))
    close()
    if out:
        yield flush()


def _tiles(docs: DataFrame, roles: DataFrame, fields: int) -> DataFrame:
    """tile, role, feed, file_seq, doc, phs, vhs: of each tile of a comparison the paths that differ and those that are gone (role 0) or new (1), with the names of the comparison, and the documents of the old (2) and the new file (3)."""
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    tile = F.xxhash64(*FILE_KEYS, "a", "b").alias("tile")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    each = roles.withColumn("a", number(F.col("old_tiles"))).withColumn("b", number(F.col("new_tiles")))
    side = lambda role, only: F.struct(F.lit(role).alias("role"), F.col(only).alias("only"))
    heads = each.withColumn("s", F.explode(F.array(side(0, "gone"), side(1, "come")))).select(tile, "s.role", *FILE_KEYS, F.lit(0).cast("bigint").alias("doc"), F.col("changed").alias("phs"), F.col("s.only").alias("vhs"))
    # a file is the new one of its own comparison and the old one of the next
    sides = docs.select("feed", "doc", "phs", "vhs", _ends()).select("feed", F.col("e.at").alias("file_seq"), "e.old", "doc", "phs", "vhs")
    sides = _join_small(sides, roles.select(*FILE_KEYS, "old_tiles", "new_tiles"), list(FILE_KEYS), fields, "doc")
    own, other = F.when(F.col("old"), F.col("old_tiles")).otherwise(F.col("new_tiles")), F.when(F.col("old"), F.col("new_tiles")).otherwise(F.col("old_tiles"))
    sides = sides.withColumn("own", F.pmod("doc", own)).withColumn("other", number(other))
    sides = sides.withColumns({"a": F.when(F.col("old"), F.col("own")).otherwise(F.col("other")), "b": F.when(F.col("old"), F.col("other")).otherwise(F.col("own"))})
    rows = sides.select(tile, F.when(F.col("old"), 2).otherwise(3).alias("role"), none("feed", "string"), none("file_seq", "int"), "doc", "phs", "vhs")
    return heads.unionByName(rows)


def _partners(docs: DataFrame, roles: DataFrame, fields: int) -> DataFrame:
    """feed, file_seq, moved_a, moved_b: the pairs of documents of both files, each the best partner of the other, with what they have under removed and under added paths. Of equal partners the first by MD5 counts."""
    best = _tiles(docs, roles, fields).repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(_pair_batches, _BEST)
    first = F.struct(-F.col("votes"), "other")
    best = best.groupBy(*FILE_KEYS, "old", "doc").agg(F.min_by(F.struct("other", "moved_a", "moved_b"), first).alias("m"))
    own, other = F.col("doc"), F.col("m.other")
    best = best.select(*FILE_KEYS, F.when(F.col("old"), own).otherwise(other).alias("old_doc"), F.when(F.col("old"), other).otherwise(own).alias("new_doc"), "m.moved_a", "m.moved_b")
    return best.groupBy(*FILE_KEYS, "old_doc", "new_doc").agg(F.count("*").alias("n"), F.max("moved_a").alias("moved_a"), F.max("moved_b").alias("moved_b")).where("n = 2").select(*FILE_KEYS, "moved_a", "moved_b")


def _renames(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """feed, file_seq, old_path, new_path proven by the documents of both files; what removed and added fields share is read off each pair of documents, without a join."""
    # read three times below
    shared = cut_lineage(_partners(docs, *_roles(docs, changes)))

    same = F.flatten(F.transform("moved_a", lambda x: F.transform(F.filter("moved_b", lambda y: y["v"] == x["v"]), lambda y: F.struct(x["p"].alias("oh"), y["p"].alias("nh"), x["v"].alias("v")))))
    agreed = shared.select(*FILE_KEYS, F.explode(same).alias("s")).groupBy(*FILE_KEYS, "s.oh", "s.nh", "s.v").agg(F.count("*").alias("n"))
    agreed = agreed.groupBy(*FILE_KEYS, "oh", "nh").agg(F.sum("n").alias("same"), F.count("*").alias("kinds_seen"))
    count = lambda column, name: shared.select(*FILE_KEYS, F.explode(column).alias("m")).groupBy(*FILE_KEYS, F.col("m.p").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    # all documents that have either field agree on both
    proven = agreed.join(count("moved_a", "oh"), [*FILE_KEYS, "oh"]).join(count("moved_b", "nh"), [*FILE_KEYS, "nh"]).where("same = n_oh and same = n_nh")
    path = lambda name, hashed: changes.select(*FILE_KEYS, F.col("path").alias(name), F.xxhash64("path").alias(hashed))
    scored = proven.join(path("old_path", "oh"), [*FILE_KEYS, "oh"]).join(path("new_path", "nh"), [*FILE_KEYS, "nh"])
    leaf = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, r"\."), -1), "[_-]", ""))
    near = F.levenshtein(leaf(F.col("old_path")), leaf(F.col("new_path")))
    order = [F.desc("kinds_seen"), F.desc("same"), near.asc(), "old_path", "new_path"]
    rank = lambda key: F.row_number().over(Window.partitionBy(*FILE_KEYS, key).orderBy(*order))
    ok = scored.withColumn("a", rank("old_path")).withColumn("b", rank("new_path"))
    return ok.where("a = 1 and b = 1").select(*FILE_KEYS, "old_path", "new_path")


def schema_changes(raw: DataFrame) -> DataFrame:
    """file_id, feed, file_seq, change_kind (added, removed, renamed, type_changed), old_path, new_path, old_kinds, new_kinds: every file against the file before it of its feed."""
    docs = cut_lineage(parsed_documents(raw))
    # small tables of schema changes that the steps below read many times
    changes = cut_lineage(_changes(raw, fused_schemas(docs)))
    renames = cut_lineage(_renames(docs, changes))
    kinds: Column = F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").otherwise("type_changed")
    join = lambda c: F.array_join(c, "|")
    plain = changes.join(renames.select(*FILE_KEYS, F.explode(F.array("old_path", "new_path")).alias("path")), [*FILE_KEYS, "path"], "left_anti")
    plain = plain.select(
        "file_id", *FILE_KEYS, kinds.alias("change_kind"), F.when(F.col("old_kinds").isNull(), "").otherwise(F.col("path")).alias("old_path"), F.when(F.col("new_kinds").isNull(), "").otherwise(F.col("path")).alias("new_path"),
        F.coalesce(join("old_kinds"), F.lit("")).alias("old_kinds"), F.coalesce(join("new_kinds"), F.lit("")).alias("new_kinds"),
    )
    of = lambda col, name: changes.select(*FILE_KEYS, F.col("path").alias(col), join(name).alias(name))
    moved = renames.join(_files(raw), [*FILE_KEYS]).join(of("old_path", "old_kinds"), [*FILE_KEYS, "old_path"]).join(of("new_path", "new_kinds"), [*FILE_KEYS, "new_path"])
    moved = moved.select("file_id", *FILE_KEYS, F.lit("renamed").alias("change_kind"), "old_path", "new_path", "old_kinds", "new_kinds")
    return plain.unionByName(moved)


def field_alternatives(raw: DataFrame) -> DataFrame:
    """feed, path, kind, docs, first_seq, last_seq: the tagged union of all files, one row per alternative of a path."""
    need = raw.select("feed", F.col("file_seq").cast("int"), F.col("payload").cast("string")).where("payload is not null")
    by_kind = need.mapInArrow(_count_batches, "feed string, file_seq int, path string, kind string, n bigint")
    return by_kind.groupBy("feed", "path", "kind").agg(F.sum("n").alias("docs"), F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"))


def canonical_names(schemas: DataFrame, renames: DataFrame) -> DataFrame:
    """feed, file_seq, path, name: the last name of each field of each file, following its renames file by file.

    schemas has feed, file_seq, path. Names may return for another field later, so a step takes the first rename of the
    current name after the file that gave it. Each round follows one rename of all fields at once; there are as many
    rounds as the longest chain of renames, and every round is a join of tables of schema size.
    """
    now = schemas.select(*FILE_KEYS, "path").distinct().withColumns({"name": F.col("path"), "since": F.col("file_seq")})
    steps = renames.select("feed", F.col("old_path").alias("name"), F.struct(F.col("file_seq").alias("at"), F.col("new_path").alias("to")).alias("step"))
    while True:
        after = now.join(steps, ["feed", "name"], "left")
        first = after.groupBy(*FILE_KEYS, "path", "name", "since").agg(F.min(F.when(F.col("step.at") > F.col("since"), F.col("step"))).alias("step"))
        now = cut_lineage(first.select(*FILE_KEYS, "path", F.coalesce("step.to", "name").alias("name"), F.coalesce("step.at", "since").alias("since"), F.col("step").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select(*FILE_KEYS, "path", "name")
        now = now.drop("moved")


def unified_table(raw: DataFrame) -> DataFrame:
    """One row per valid document in one schema: file_id, line_no, feed, doc_type and a column per field of any file.

    A renamed field stands under its last name in the feed. A field of one JSON type has that type (string, double, boolean; arrays as
    JSON text); one of several types has a typed branch for each, `<field>__<type>`, and `<field>` as text, the canonical form of all.
    Dots in paths become double underscores. A document is known by its file (feed, file_seq, file_id), line_no and values: repeated deliveries
    are one row, other values on the same line or where keys are null are rows of their own. An object without any value ('{}', nulls only)
    is a row without fields. Where feed or file_seq is null no rename is known, so fields keep their own names. The driver only learns the names and types of fields, at most MAX_FIELDS, however many feeds and files there are.
    """
    docs = cut_lineage(parsed_documents(raw))
    schemas = cut_lineage(fused_schemas(docs))
    names = canonical_names(schemas, cut_lineage(_renames(docs, cut_lineage(_changes(raw, schemas)))))
    # null keys meet no name: such fields keep their own
    name = F.coalesce("name", "path").alias("name")
    alternatives = schemas.join(names, [*FILE_KEYS, "path"], "left").select(name, F.explode("kinds").alias("kind")).groupBy("name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    kinds = {r["name"]: r["kinds"] for r in alternatives.limit(MAX_FIELDS + 1).collect()}
    if len(kinds) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields: keys of objects look like data; use field_alternatives")
    leaves = _typed_leaves(raw).withColumn("salt", F.pmod("doc", F.lit(_SALTS)).cast("int"))
    spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    leaves = leaves.join(spread, [*FILE_KEYS, "path", "salt"], "left").withColumn("name", name)
    leaf = F.when(F.col("path").isNotNull(), F.struct("name", (F.col("path") != F.col("name")).alias("old"), F.struct("kind", "value").alias("v")))
    docs = leaves.groupBy("file_id", "line_no", *FILE_KEYS, "doc").agg(F.array_sort(F.collect_list(leaf)).alias("all"), F.max("doc_type").alias("doc_type"))
    # a document can hold a field under its old and its last name; the last one holds
    once = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["name"] != x["name"]))
    docs = docs.select("file_id", "line_no", "feed", "doc_type", F.map_from_entries(F.transform(once, lambda x: F.struct(x["name"], x["v"]))).alias("m"))
    typed = {"string": lambda v: v, "array": lambda v: v, "number": lambda v: v.try_cast("double"), "boolean": lambda v: v.try_cast("boolean")}
    columns = []
    for path in sorted(kinds):
        cell, name = F.col("m").getItem(path), path.replace(".", "__")
        if len(kinds[path]) == 1:
            columns.append(typed[kinds[path][0]](cell["value"]).alias(name))
        else:
            columns.append(cell["value"].alias(name))
            columns += [F.when(cell["kind"] == k, typed[k](cell["value"])).alias(f"{name}__{k}") for k in kinds[path]]
    return docs.select("file_id", "line_no", "feed", "doc_type", *columns)
