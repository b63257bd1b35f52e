"""Token counts, structure repair and Merkle manifests against brute force and their SQL, on small fixtures with nulls, ties, repeats and hot keys."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import manifest, structure_repair, token_counts

CLASH = ["id", "part", "pos", "blk", "at", "n", "tree", "place", "digest", "kind", "number", "audit", "piece", "copies_", "h", "key"]


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


def by_sql(sql, table, rows, ddl):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({ddl})")
    if rows:
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


# ---- 11

SYMBOLS = ["a", "B", "'s", "'", "  ", " ", "\n", "\t", "\r\n", "9", "12", "é", "中", "\U0001f600", "<|endoftext|>", "<|", "!", "　", "\x1c", "İ", "word", " the"]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_cuts_change_no_count(vocabulary):
    own, r = token_counts.Counter(public_tokenizers.path(vocabulary)), random.Random(1)
    assert own.places is not None
    cut = 0
    for _ in range(1500):
        text = "".join(r.choice(SYMBOLS) for _ in range(r.randrange(1, 60)))
        parts = token_counts.cuts(text, own.places, r.randrange(1, 8))
        cut += len(parts) > 1
        assert sum(own.count(parts)) == own.count([text])[0]
        if vocabulary.endswith(".json"):
            assert "".join(parts) == text
    assert cut > 400


def test_batches_are_balanced():
    own = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["word " * n for n in (1, 900, 2, 0, 30, 4, 900)]
    calls, count = [], own.count
    own.count = lambda some: calls.append(sum(map(len, some))) or count(some)
    assert own.balanced(texts, np.array([len(x) for x in texts]), 1000).tolist() == count(texts)
    assert all(c <= 1000 or c == 4500 for c in calls) and len(calls) == 3


def test_token_counts(spark):
    long = "No blanks" + "x" * 3000 + "9" * 500 + " and words\n\n then" * 700
    rows = [(1, "plain text"), (2, None), (3, ""), (4, long), (4, long), (None, "no id <|endoftext|> here"), (None, None), (5, long[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH + ["n_bytes", "n_tokens"]}).repartition(3)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 20) for i, x in rows]
    for size in (10_000_000, 100):  # nothing is long, nearly everything is
        got = token_counts.count_tokens(df, limit=20, long_bytes=size, piece=64, batch_bytes=300)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and plain(got.collect()) == plain(want)
    assert token_counts.count_tokens(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_counts.Counter("ranks.tiktoken")


# ---- 12

CONVERSATIONS = "conv_id long, turn long, role string, text string"
CON_DDL = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"


def brute_force(rows):
    """Cheapest edits of (role, text, must go, truncated) by trying all: cost, audit, repaired lines."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = [["D"] if gone else ["D", "K", "u", "a"] for _, _, gone, _ in rows]
    for edits in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, roles, lines = 5 * sum(map(len, put)), "", "", []
            for i, extra in enumerate(put):
                audit += "I" * len(extra)
                roles += "".join(extra)
                lines += [{"u": "user:", "a": "assistant:"}[x] for x in extra]
                if i < len(rows):
                    role, text, _, cut = rows[i]
                    e = edits[i]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if cut and e != "D" else 0)
                    if e != "D":
                        role = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                        roles += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            body = roles[1:] if roles[:1] == "s" else roles
            legal = not roles or (body and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))
            if legal and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def test_every_short_conversation_against_all_edits():
    kinds = {"s": ("system", 0), "u": ("user", 0), "a": ("assistant", 0), "o": ("tool", 0), "S": ("system", 1), "U": ("user", 1), "A": ("assistant", 1), "O": ("", 1), "X": ("user", 0)}
    for n in (1, 2, 3):
        every = list(itertools.product(kinds, repeat=n))
        for kind in every if n < 3 else random.Random(2).sample(every, 60):
            want = brute_force([(*kinds[k][:1], f"t{i}", k == "X", kinds[k][1]) for i, k in enumerate(kind)])
            found = structure_repair.solve("".join(kind), 0)
            got = min((cost + structure_repair.ENDS[s][0], audit + structure_repair.ENDS[s][1]) for s, (cost, audit) in found.items())
            assert got == want[:2]


def test_audits_compare_like_texts():
    """Least audits of long rows equal those that plain texts find, also if every hash collides."""

    def plainly(kinds, entry):
        cells = {entry: (0, "")}
        for k in kinds:
            found = {}
            for state, to, cost, added in structure_repair.STEPS[k]:
                if state in cells:
                    new = (cells[state][0] + cost, cells[state][1] + added)
                    found[to] = min(found.get(to, new), new)
            cells = found
        return cells

    r = random.Random(3)
    base = structure_repair.Audits.BASE
    try:
        for b in (base, 0):
            structure_repair.Audits.BASE = b  # 0: the hash is the last character
            for _ in range(60):
                kinds = "".join(r.choice("XsuaoSUAO"[: r.choice((4, 5, 9))]) for _ in range(r.choice((5, 40, 300))))
                for entry in range(4):
                    assert structure_repair.solve(kinds, entry) == plainly(kinds, entry)
    finally:
        structure_repair.Audits.BASE = base


def turns(n, seed):
    r = random.Random(seed)
    out = []
    for conv in [None, 1, 2, 3] + [7] * 12 + list(range(10, 40)):
        for t in range(r.randrange(0, n) if conv != 7 else n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ulf"])
            text = r.choice(["Yes.", "No", "", None, " \n", "Right!  ", f"number {r.randrange(9)}.", "naïve…", "line\none.\n"])
            out.append((conv, None if r.random() < 0.08 else r.choice((t, t, t - 1, t * 3)), role, text))
    return out + out[:9]


@pytest.mark.parametrize("rows,size", [(2048, 1_000_000), (3, 1_000_000), (50, 40)])
def test_structure_repair_equals_its_sql(spark, rows, size):
    """Blocks of all sizes, a conversation that holds most rows, repeated rows, nulls everywhere."""
    data = turns(25, rows)
    df = spark.createDataFrame(data, CONVERSATIONS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    got = structure_repair.repaired_damage(df, rows, size)
    names, want = by_sql(structure_repair.SQL, "conversations", data, CON_DDL)
    assert sorted(names) == sorted(got.columns) and len(want) > 20
    assert plain(got.select(*names).collect()) == plain(want)


def test_repair_without_rows(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(str(tmp_path / "a/conversations.parquet"))
    assert structure_repair.op12_structure_repair(spark, str(tmp_path / "a")).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVERSATIONS).write.parquet(str(tmp_path / "b/conversations.parquet"))
    (row,) = structure_repair.op12_structure_repair(spark, str(tmp_path / "b")).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    """The operator's own output: turns, in order, with what is inserted."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", " "), (1, 3, "assistant", "Yes."), (1, 4, "user", "Bye."), (2, 0, "user", "Alone.")]
    found = structure_repair.plan(df := spark.createDataFrame(rows, CONVERSATIONS))
    got = {r.conv_id: [] for r in found.report.collect()}
    for r in structure_repair.repaired(df, found.edits).orderBy("conv_id", "number", "at").collect():
        got[r.conv_id] += [(t.role, t.text) for t in r.turns]
    assert {r.conv_id: r.audit for r in found.report.collect()} == {1: "KKDKD", 2: "D"}
    assert got == {1: [("system", "Be kind."), ("user", "Hi."), ("assistant", "Yes.")], 2: []}


# ---- 13

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def root(nodes):
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0]


def corpus(n):
    r = random.Random(n)
    names = ["hot"] * 6 + [None, "", "é", "z", "\U0001f600", "a"]
    rows = [(r.choice((i, i, i, None)), r.choice(names), r.choice(("en", None)), r.choice((i, None)), r.choice((None, "", f"text {i}", f"two\nlines {i}\n"))) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("levels", [7, 1, 2])
def test_manifest_equals_its_sql(spark, levels):
    """Blocks of three and of nine leaves make trees of many blocks and levels."""
    data = corpus(400)
    df = spark.createDataFrame(data, DOCS).withColumns({c: F.lit("x") for c in ("id", "tree", "place", "n", "leaf", "other", "block", "up", "top")}).repartition(5)
    got = manifest.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")), levels=levels)
    names, want = by_sql(manifest.SQL, "documents", data, "doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR")
    assert names == got.columns and plain(got.collect()) == plain(want)
    trees = {}
    for d, s, *more in data:
        trees.setdefault(s, []).append((d is not None, d or 0, h("".join(map(field, (d, s, *more))))))
    subroots = [root([x for _, _, x in sorted(trees[s])]) for s in sorted(trees, key=lambda s: (s is not None, (s or "").encode()))]
    assert {r[names.index("root")] for r in want} == {root(subroots)} and {r[names.index("subroot")] for r in want} == set(subroots)


def test_versions_share_what_they_do_not_copy():
    leaves = [h(str(i)) for i in range(25)]
    tree = manifest.Tree(leaves, None)
    size, kept = len(tree.digest), list(tree.digest)
    for i in (0, 13, 24):
        other = tree.with_leaf(i, h("other"))
        assert tree.digest[other] == root(leaves[:i] + [h("other")] + leaves[i + 1 :]) == manifest.fold(h("other"), tree.siblings(i))
        assert len(tree.digest) - size == len(tree.rows)  # the leaf and its ancestors
        tree.drop_versions()
        assert tree.digest == kept and len(tree.children) == size
    siblings = tree.siblings(24)
    assert manifest.unpack(manifest.pack(siblings)) == siblings


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([], DOCS)
    assert manifest.manifest(df, F.lit(True), F.col("text")).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    (row,) = manifest.manifest(one, F.lit(True), F.col("text")).collect()
    leaf = h("1:1----")
    assert tuple(row) == (1, leaf, leaf, leaf, h(""), leaf, True)
