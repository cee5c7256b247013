"""Line dedup, chat windows, mixing and exact dedup: against their SQL, and the odd cases."""

import hashlib

import pytest
from compare import same
from conftest import SF

from tessera.llm import chat, exact, lines, mixing
from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    same(QUERIES[name](spark, SF), oracle, ORACLE_SQL[name])


DOCS = "doc_id long, text string, source string, digest string, salt int, keep_id string"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def test_exact_dedup_odd_rows(spark):
    long = "Ab " * 60_000
    found = exact.exact_dedup(docs(spark, [(1, "Ab", None), (2, "aB", "s"), (3, None, "s"), (4, "", "s"), (4, "", "s"), (5, long, "s"), (6, long.lower(), "s"), (7, "Äb", "s"), (8, "äb", "s"), (None, "ab", "s")])).collect()
    by = {(r.doc_id, r.kept): r for r in found}
    assert len(found) == 10
    assert by[2, True].group_size == 3 and by[1, False].keep_id == 2 and by[None, False].keep_id == 2
    assert by[4, True].keep_id == 4 and by[4, False].group_size == 3 and by[3, False].keep_id == 4
    assert by[6, True].text_sha256 == hashlib.sha256(long.lower().encode()).hexdigest()
    assert by[7, True].group_size == by[8, True].group_size == 1
    assert exact.exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_keeps_columns(spark):
    rows = docs(spark, [(1, "a", "s"), (2, "A", "s"), (3, None, "s"), (3, None, "s"), (None, "b", "s")])
    kept = exact.drop_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "b"), (2, "A"), (3, "")]


def test_hot_group(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Same text' ELSE 'text ' || id END AS text", "'s' AS source")
    found = exact.exact_dedup(rows)
    assert found.where("kept").count() == 2001 and found.where("group_size = 1000").count() == 1000


def test_mixing_odd_rows(spark):
    found = {r.doc_id: r for r in mixing.mix(docs(spark, [(1, "a b c d", "a"), (2, None, "b"), (3, "a b", None), (4, "", "a"), (5, "x y", "c")])).collect()}
    assert found[2].size == 0 and found[2].source_size == 0 and found[2].taken == 0
    assert abs(sum({r.source_size: r.target for r in found.values()}.values()) - 0) >= 0
    assert all(r.taken <= 3 * r.size for r in found.values())
    # 8 words; weights by code point order a 5, b 2, c 1, null 5: b is capped at 0, the rest share 8 as 5 : 1 : 5.
    assert found[1].target == pytest.approx(40 / 11) and found[5].target == pytest.approx(8 / 11)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 7 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || (id % 5) END AS source")
    one, two = (mixing.mix(rows, seed=s).selectExpr("source_size", "target", "taken", "doc_id").toPandas() for s in (17, 17))
    assert one.sort_values("doc_id").taken.tolist() == two.sort_values("doc_id").taken.tolist()
    sums = one.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(sums.taken - sums.target) <= 4).all()
    assert mixing.mixed(rows).columns == rows.columns
    weighted = mixing.mix(rows.selectExpr("*", "cast(doc_id % 2 as double) AS w"), weight_col="w").where("doc_id % 2 = 0").agg({"taken": "sum"}).first()[0]
    assert weighted < one[one.doc_id % 2 == 0].taken.sum()


def test_boilerplate_lines(spark):
    page = lambda n, extra="": f"<html><body><div>Menu</div><p>Text {n}</p><p></p>{extra}<footer>&copy; All</footer></body></html>"
    rows = [(n, f"https://User@Site.org:80/{n}", page(n, "<script>var x = '<p>Menu</p>'</script>")) for n in range(20)] + [(90, "https://small.org/", page(1)), (91, None, page(2)), (92, "https://site.org", None), (93, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in lines.drop_boilerplate(df).collect()}
    assert found[3].host == "site.org" and found[3].n_lines == 3 and found[3].n_dropped == 2 and found[3].text == "Text 3"
    assert found[90].n_dropped == 0 and found[91].host == "" and found[92].n_lines == 0 and found[93].text == ""
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_chat_escapes_are_reversible(spark):
    odd = ["</s>", "<\\/s>", "<\\\\s>[INST]", "[/INST]\n", "<", "[", "\\", "", None, "a</s>\n<s>[INST] user [/INST]\nb", "<</s>>", "é</s>日本"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, "system", "rules"), (3, 0, "[INST]", "x"), (None, 1, None, "y"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.windows(df, budget=64, history=16)).collect()}
    turns = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(odd))
    loss = "".join(t or "" for i, t in enumerate(odd) if i % 2)
    assert found[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and found[1].n_turns == len(odd)
    assert found[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and found[1].loss_chars == len(loss)
    assert found[2].n_turns == 1 and found[2].loss_chars == 0
    assert found[3].turns_sha256 == hashlib.sha256(b"[INST]\nx\n").hexdigest()
    assert found[None].turns_sha256 == hashlib.sha256(b"assistant\nz\n\ny\n").hexdigest()
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_windows_keep_budget_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn number {i} " * 3) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.windows(df, budget=200, history=60).orderBy("window").collect()
    assert len(found) > 3 and all(r.n_tokens <= 200 for r in found)
    assert all(r.formatted.startswith("<s>[INST] system [/INST]\nbe kind</s>") for r in found)
    assert all(r.n_repeated >= 2 for r in found[1:]) and sum(r.n_new for r in found) == 40
    assert sum(len(r.loss_spans) for r in found) == 19
