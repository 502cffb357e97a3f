"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document's set are its distinct word shingles, as 64-bit hashes; documents with equal sets form a class (64-bit digest),
and only classes are joined. Two sets link if ``100 * intersection >= PERCENT * union``.

Prefixes. All tokens have one global order: rare ones by hash, then frequent ones by hash. A set of ``n`` tokens may miss
``t = n - ceil(PERCENT * n / 100)`` tokens in a partner. Its prefix goes on until ``t + 1`` misses would be needed to hide
it: a rare token counts one and is indexed by itself; frequent tokens are dealt into groups, a group of ``p`` tokens counts
``p - 1`` and is indexed by its pairs, so the prefix is extended where tokens are frequent. Linked sets then share
an index entry. The groups' number depends on the set's size, in powers of two; a set near a power's border is indexed for
both
sides. A token is frequent if all its words are (``WORD_COUNT``), since such tokens meet by chance, or if more than
``FREQUENT`` classes have it in their first prefix, as passages that many documents share do; of the latter at most
``FREQUENT_TOKENS`` (the most frequent) are treated so. That bounds what is sent to the tasks and changes costs only.

Links. Each entry's most central class is its leader. Every other class of the entry is compared with it, first by prefix:
up to the nearer end of two prefixes all rare tokens of both sets are known, which bounds the intersection. What that leaves
possible makes families, and is verified on whole sets. Classes of a family that are in different components then, and
classes of different families that share an entry (again as far as prefixes leave it possible), are verified in blocks:
classes are dealt into blocks of about ``BLOCK``, pairs of blocks are tasks, and only links that connect something new are
returned. So no link between components is missed, no pairs are written out, and a group of near copies costs one
comparison each as a rule.

Cases: null and empty texts and texts without words have no shingles and link with nothing; texts with fewer words than a
shingle are one shingle; rows are joined by their sets, so repeated keys and rows are fine; a null key takes part and is
never a component's id unless all keys are null; only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import free_name, map_texts, process_memory, slices
from eventide.llm.components import connected_components
from eventide.session import release, stage

SHINGLE, PERCENT = 3, 90
#: Words that occur so often are frequent; at most ``WORDS`` of them, the most frequent.
WORD_COUNT, WORDS = 8, 1_000_000
#: Tokens that so many documents of a task's buffer have are frequent; at most ``FREQUENT_TOKENS`` of them.
FREQUENT, FREQUENT_TOKENS, BUFFER = 4, 200_000, 3_000_000
#: Tables of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000
GROUP = 8
BLOCK = 256
SLICE_BYTES, CHUNK = 2_000_000, 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Base of the words' polynomial hash and its inverse modulo 2**64.
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SLOT_BITS = 24
_RARE, _REST = np.uint64(1 << 63), np.int64((1 << 63) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    powers = process_memory("ngram_join", lambda: [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])
    if len(powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            powers[i] = np.multiply.accumulate(steps)
    return powers


def _words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of some bytes."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]
    return _mix((total[end] - total[first]) * down[first]), first


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word, cut at ASCII white space; worked out in chunks that end between words."""
    data, at, found = np.frombuffer(raw, np.uint8), 0, []
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        hashes, first = _words_of(data[at:end])
        found.append((hashes, first + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([f for _, f in found])


def word_table(hashes: np.ndarray) -> np.ndarray:
    """Which slots of the word hash are frequent, as bits; a rare word in such a slot counts as frequent everywhere."""
    table = np.zeros(1 << _SLOT_BITS, bool)
    table[hashes >> np.uint64(64 - _SLOT_BITS)] = True
    return np.packbits(table)


def token_sets(texts: list[str | None], size: int = SHINGLE, table: np.ndarray | None = None, with_words: bool = False):
    """Sorted tokens of every text's set; tokens with a rare word are negative, so they come first.

    Words are cut at ASCII white space, A-Z lower-cased. A token stands for ``size`` words, or for all words of a shorter text.
    ``with_words``: the hashes of all words as well.
    """
    raws = [(t or "").encode().lower() for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    words, places = word_hashes(b"\n".join(raws))
    rare = np.ones(len(words), bool)
    if table is not None:
        slot = words >> np.uint64(64 - _SLOT_BITS)
        rare = (table[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 0
    bounds = np.searchsorted(places, starts)

    def tokens(a: int, b: int, n: int) -> np.ndarray:
        mixed, some = words[a : b - n + 1] + np.uint64(n), rare[a : b - n + 1].copy()
        for k in range(1, n):
            mixed = _mix(mixed) + words[a + k : b - n + 1 + k]
            some |= rare[a + k : b - n + 1 + k]
        mixed = _mix(mixed)
        return np.where(some, mixed | _RARE, mixed & ~_RARE).view(np.int64)

    long = tokens(0, len(words), size) if len(words) >= size else np.zeros(0, np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(np.unique(long[a : b - size + 1]) if b - a >= size else tokens(a, b, b - a) if b > a else long[:0])
    return (out, words) if with_words else out


def misses(n: int, percent: int = PERCENT) -> int:
    """Most tokens of a set of ``n`` that a linked set may lack."""
    return n - -(-percent * n // 100)


def least_size(percent: int = PERCENT) -> int:
    """Smaller sets link with equal sets only."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _levels(n: int, percent: int) -> list[int]:
    """Powers of two whose grouping a set of ``n`` tokens takes part in."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return list(range(low.bit_length() - 1, high.bit_length()))


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """Index entries of a sorted set, and whether they're just its first rare tokens."""
    n = len(tokens)
    if n < least_size(percent):
        return tokens[:0], True
    need = misses(n, percent) + 1
    often = tokens >= 0
    if len(frequent):
        plain = tokens & _REST
        often |= frequent[np.minimum(np.searchsorted(frequent, plain), len(frequent) - 1)] == plain
    rare = tokens[~often]
    if len(rare) >= need:
        return rare[:need], True
    parts, often = [rare], np.sort(tokens[often])
    for level in _levels(n, percent):
        groups = max(1, (1 << level) // GROUP)
        group = _mix(often.view(np.uint64)) % np.uint64(groups)
        left, members = need - len(rare), {}
        for token, g in zip(often.tolist(), group.tolist()):
            if left <= 0:
                break
            left -= g in members
            members.setdefault(g, []).append(token)
        for g, own in members.items():
            own = np.array(own, np.int64).view(np.uint64)
            i, j = np.triu_indices(len(own), 1)
            parts.append(_mix(_mix(own[i] + np.uint64(level)) + own[j] * _B).view(np.int64))
    return np.unique(np.concatenate(parts)), False


def repeated(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur at least so often, and their counts; sorts ``values`` and copies only what it returns."""
    values.sort()
    n = max(0, len(values) - least + 1)
    several = np.unique(values[:n][values[len(values) - n :] == values[:n]])
    return several, np.searchsorted(values, several, "right") - np.searchsorted(values, several)


def statistics(documents: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words and tokens, counted over all documents in one pass.

    A task reports the words that it has twice, and the tokens that ``FREQUENT`` documents of a buffer have, so what is rare
    everywhere isn't sent. Both lists are bounded; they change costs, never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def rows(kind: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], names=["kind", "value", "n"])

        for part in slices(batches, 0, SLICE_BYTES):
            sets, new = token_sets(part.column(0).to_pylist(), size, with_words=True)
            new, count = np.unique(new, return_counts=True)
            words, place = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, count]), minlength=len(words)).astype(np.int64)
            tokens += [s & _REST for s in sets]
            if sum(map(len, tokens)) > BUFFER:
                held, tokens = np.concatenate(tokens), []
                yield rows(1, *repeated(held, FREQUENT))
        if tokens:
            held, tokens = np.concatenate(tokens), []
            yield rows(1, *repeated(held, FREQUENT))
        yield rows(0, words[counts > 1], counts[counts > 1])

    counts = map_texts(documents.select(F.col(text).cast("string").alias("text")), run, "kind int, value bigint, n bigint")
    counts = stage(counts.groupBy("kind", "value").agg(F.sum("n").alias("n")), "frequent")

    def top(kind: int, least: int, most: int) -> np.ndarray:
        rows = counts.where((F.col("kind") == kind) & (F.col("n") >= least)).orderBy(F.desc("n"), "value").limit(most)
        return rows.select("value").toArrow().column(0).to_numpy()  # at most ``most`` numbers

    return top(0, WORD_COUNT, WORDS).view(np.uint64), np.sort(top(1, 2 * FREQUENT, FREQUENT_TOKENS))


def _class_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def indexed(documents: DataFrame, table: np.ndarray, frequent: np.ndarray, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per document: ``key``, ``class``, ``n`` (size of its set), ``entries`` and whether they are ``plain``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            sets = token_sets(part.column(1).to_pylist(), size, table)
            found = [signatures(s, frequent, percent) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            entries = pa.array([e for e, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), _class_ids(sets), n, pa.array([x for _, x in found], pa.bool_()), entries], names=["key", "class", "n", "plain", "entries"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, class bigint, n bigint, plain boolean, entries array<bigint>")


def small(df: DataFrame) -> DataFrame:
    """A staged narrow table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def whole_sets(documents: DataFrame, table: np.ndarray, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``class`` and its ``tokens`` for the classes of ``wanted`` (``class``, ``key`` of a document that has it); staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE_BYTES):
            sets = token_sets(part.column(0).to_pylist(), size, table)
            yield pa.RecordBatch.from_arrays([_class_ids(sets), pa.array(sets, pa.list_(pa.int64()))], names=["class", "tokens"])

    wanted = stage(wanted.select("class", F.col("key").alias("wanted_key")), "wanted")
    keys, classes = small(wanted.select("wanted_key").distinct()), small(wanted.select("class"))
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(keys, F.col("key").eqNullSafe(F.col("wanted_key")), "left_semi").dropDuplicates(["key", "text"]).select("text")
    found = map_texts(rows, run, "class bigint, tokens array<bigint>").join(classes, "class", "left_semi")
    return stage(found, "sets")


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """Whether two plain prefixes leave a link possible: up to the nearer end both sets' rare tokens are all known."""
    end = min(a[-1], b[-1])
    x, y = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
    return 100 * most >= percent * (n + m - most)


def possible(n: np.ndarray, plain: np.ndarray, prefixes: list[np.ndarray], rows: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` for some sets of a block with all; sets without a plain prefix are judged by size alone."""
    out = 100 * np.minimum(n[rows, None], n[None, :]) >= percent * np.maximum(n[rows, None], n[None, :])
    both = plain[rows, None] & plain[None, :]
    some = np.flatnonzero(plain)
    if len(some) and both.any():
        shared = _overlaps([prefixes[i] if plain[i] else prefixes[i][:0] for i in range(len(n))], rows)
        ends = np.array([p[-1] if x else 0 for p, x in zip(prefixes, plain)], np.int64)
        known = np.stack([np.searchsorted(prefixes[i], np.minimum(ends[i], ends), "right") if plain[i] else np.zeros(len(n), np.int64) for i in range(len(n))])
        most = shared + np.minimum(n[rows, None] - known[rows], n[None, :] - known[:, rows].T)
        out &= ~both | (100 * most >= percent * (n[rows, None] + n[None, :] - most))
    return out


def _overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets of a block with all."""
    out = np.zeros((len(rows), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    slot = np.full(len(count), -1)
    slot[shared] = np.arange(len(shared))
    owner, column = owner[slot[token] >= 0], slot[token][slot[token] >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, len(shared), 8_192):
        a, b = np.searchsorted(column, [start, start + 8_192])
        x = np.zeros((len(sets), min(8_192, len(shared) - start)), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        out += x[rows] @ x.T
    return out


def new_links(labels: list[int], components: list[int], sets: list[np.ndarray], minor: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of minor classes with others of another label, as pairs of components; one is enough to join two components."""
    size, rows, name = np.array([len(s) for s in sets]), np.flatnonzero(minor), np.array(labels)
    both = _overlaps(sets, rows)
    a, b = np.nonzero((100 * both >= percent * (size[rows, None] + size[None, :] - both)) & (name[rows, None] != name[None, :]))
    root = {x: x for x in components}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in zip(rows[a].tolist(), b.tolist()):
        x, y = find(components[i]), find(components[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((components[i], components[j]))
    return found


def _star_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every class with the leaders of its entries, as far as their prefixes leave a link possible; staged."""
    # central: few entries that no other class has; an original has none, an edited copy has those of its edits
    sizes = classes.select("class", "n", F.size("entries").alias("total"))
    central = members.groupBy("class").count().join(sizes, "class").select("class", "n", (F.col("count") - F.col("total")).alias("rank"))
    leaders = members.join(central, "class").groupBy("entry").agg(F.max(F.struct("rank", "class", "n")).alias("top"))
    pairs = members.join(leaders, "entry").select("class", F.col("top.class").alias("leader")).where("class <> leader").distinct()
    pairs = small(stage(pairs, "pairs"))
    theirs = classes.select(F.col("class").alias("leader"), F.col("n").alias("m"), F.col("plain").alias("leader_plain"), F.col("entries").alias("theirs"))
    both = classes.join(pairs, "class").join(theirs, "leader").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a_plain, b_plain, a, b = (batch.column(i) for i in range(2, 8))
            n, m, plain = n.to_numpy(), m.to_numpy(), a_plain.to_numpy(zero_copy_only=False) & b_plain.to_numpy(zero_copy_only=False)
            kept = [not plain[i] or may_link(a[i].values.to_numpy(), n[i], b[i].values.to_numpy(), m[i], percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(kept, pa.bool_()))

    both = both.select("class", "leader", "n", "m", "plain", "leader_plain", "entries", "theirs")
    return stage(map_texts(both, run, "class bigint, leader bigint, n bigint, m bigint"), "pairs")


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that whole sets confirm."""
    leaders = sets.join(small(stage(pairs.select(F.col("leader").alias("class")).distinct(), "leaders")), "class", "left_semi")
    theirs = leaders.select(F.col("class").alias("leader"), F.col("tokens").alias("theirs"))
    both = sets.join(small(pairs), "class").join(theirs, "leader").select("class", "leader", "n", "m", F.size(F.array_intersect("tokens", "theirs")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select(F.col("class").alias("a"), F.col("leader").alias("b"))


def _dealt(named: DataFrame) -> DataFrame:
    """Tasks that meet every two classes of a group that differ in ``label``; in: ``grp``, ``class``, ``label``, ``component``.

    A group's most frequent label is its major one; its classes needn't be compared with each other. All others are compared
    with them and among themselves, in pairs of blocks. Groups of the same classes are handled once.
    """
    mark = F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("mark")
    parts = named.groupBy("grp", "label").agg(F.count("*").alias("size"), mark)
    groups = parts.groupBy("grp").agg(
        F.sum("size").alias("size"), F.count("*").alias("labels"), F.max(F.struct("size", "label")).alias("major"), F.sum("mark").alias("mark")
    ).where("size > 2 and labels > 1")
    groups = groups.groupBy("size", "mark").agg(F.min(F.struct("grp", "major")).alias("x")).select("x.grp", "x.major", "size")
    n_major, n_minor = F.ceil(F.col("major.size") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("major.size")) / BLOCK).cast("int")
    dealt = named.join(groups, "grp").select(
        "grp", "class", "label", "component", (F.col("label") == F.col("major.label")).alias("is_major"), n_major.alias("n_major"), n_minor.alias("n_minor")
    ).withColumn("own", F.pmod(F.xxhash64("class", "grp"), F.when(F.col("is_major"), F.col("n_major")).otherwise(F.col("n_minor"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    tasks = F.when(F.col("is_major"), F.transform(upto(F.col("n_minor")), lambda i: task("across", i, own))).otherwise(
        F.concat(
            F.transform(upto(F.col("n_major")), lambda j: task("across", own, j)),
            F.transform(F.filter(upto(F.col("n_minor")), lambda i: i != own), lambda i: task("minor", F.least(i, own), F.greatest(i, own))),
        )
    )
    return dealt.select("grp", "class", "label", "component", "is_major", F.explode(tasks).alias("task")).select("grp", "class", "label", "component", "is_major", "task.*")


def _candidates(dealt: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of tasks' rows those whose prefix leaves a link with another label possible."""

    def run(table: pa.Table) -> pa.Table:
        minor, name = ~table.column("is_major").to_numpy(), table.column("label").to_numpy()
        rows = np.flatnonzero(minor)
        entries = table.column("entries").combine_chunks()
        prefixes = [entries[i].values.to_numpy() for i in range(len(entries))]
        linked = possible(table.column("n").to_numpy(), table.column("plain").to_numpy(), prefixes, rows, percent) & (name[rows, None] != name[None, :])
        kept = linked.any(axis=0)
        kept[rows] |= linked.any(axis=1)
        return table.select(["grp", "class", "label", "component", "is_major", "kind", "i", "j"]).filter(pa.array(kept))

    schema = "grp bigint, class bigint, label bigint, component bigint, is_major boolean, kind string, i int, j int"
    return dealt.join(classes, "class").groupBy("grp", "kind", "i", "j").applyInArrow(run, schema)


def _block_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that whole sets confirm; enough of them to join what is linked."""

    def run(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        sets_ = [tokens[i].values.to_numpy() for i in range(len(tokens))]
        found = new_links(table.column("label").to_pylist(), table.column("component").to_pylist(), sets_, ~table.column("is_major").to_numpy(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.join(sets, "class").groupBy("grp", "kind", "i", "j").applyInArrow(run, "a bigint, b bigint")


def join_components(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: the key, ``n_shingles`` and ``component_id``, the smallest key reachable by links."""
    words, frequent = statistics(documents, text, size)
    table = word_table(words)
    prefixes = stage(indexed(documents, table, frequent, key, text, size, percent), "prefixes")
    each = stage(prefixes.select("key", "class", "n"), "sizes")
    classes = stage(prefixes.where(F.size("entries") > 0).dropDuplicates(["class"]).select("class", "n", "plain", "entries"), "classes")
    release(prefixes)
    index = classes.select("class", F.explode("entries").alias("entry"))
    shared = index.groupBy("entry").count().where("count > 1").select("entry")
    members = stage(index.join(shared, "entry"), "members")
    known = each.where("n > 0").groupBy("class").agg(F.min("key").alias("key"))
    sets_of = lambda some: whole_sets(documents, table, known.join(some.distinct(), "class", "left_semi"), key, text, size)

    # families: classes that leaders bring together, as far as prefixes tell; components: those that whole sets confirm
    pairs = _star_pairs(members, classes, percent)
    families = stage(connected_components(pairs, "class", "leader").select(F.col("node").alias("class"), F.col("component").alias("family")), "families")
    sets = sets_of(families.select("class"))
    labels = stage(connected_components(_star_links(pairs, sets, percent)), "labels")
    of = labels.select(F.col("node").alias("class"), "component")
    within = families.join(of, "class", "left").withColumn("component", F.coalesce("component", "class"))
    bridges = stage(_block_links(_dealt(within.select(F.col("family").alias("grp"), "class", F.col("component").alias("label"), "component")), sets, percent), "bridges")
    release(sets)
    across = members.join(within, "class", "left").select(
        F.col("entry").alias("grp"), "class", F.coalesce("family", "class").alias("label"), F.coalesce("component", "class").alias("component")
    )
    rest = stage(_candidates(_dealt(across), classes, percent), "candidates")
    bridges = connected_components(bridges.unionByName(_block_links(rest, sets_of(rest.select("class")), percent)))
    bridges = bridges.select(F.col("node").alias("component"), F.col("component").alias("top"))
    # classes that no star linked may still be bridged, under their own number
    nodes = labels.select(F.col("node").alias("class"), "component").unionByName(
        bridges.select(F.col("component").alias("class"), "component").join(labels.select(F.col("node").alias("class")), "class", "left_anti")
    )
    tops = nodes.join(bridges, "component", "left").select("class", F.coalesce("top", "component").alias("top"))
    keyed = known.join(tops, "class", "left").select("class", F.coalesce("top", "class").alias("top"), "key")
    first = keyed.groupBy("top").agg(F.min("key").alias("component_id"))
    named = keyed.join(first, "top").select("class", "component_id")
    return each.join(named, "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one document of each component: the one with the smallest key; rows with a null key stay."""
    found = join_components(documents, key, text, size, percent)
    name = free_name(documents.columns, "kept")
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(name)).distinct()
    named = documents.where(F.col(key).isNotNull())
    return named.join(kept, F.col(key) == F.col(name), "left_semi").unionByName(documents.where(F.col(key).isNull()))


def oracle() -> str:
    """The same components in DuckDB's SQL, over all pairs that share a shingle."""
    return rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= {SHINGLE} then [array_to_string(ws[i : i + {SHINGLE - 1}], ' ') for i in range(1, len(ws) - {SHINGLE - 2})]
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join least on least.a = w.doc_id
"""
