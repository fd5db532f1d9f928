"""Literal cases of understanding, extraction, retrieval repair, checking and the conversation store."""

from pyspark.sql import functions as F

from basalt.operators import concepts as N
from basalt.operators import extract as X
from basalt.operators import memory as C
from basalt.operators import query as G
from basalt.operators import rank as R
from basalt.operators import records as D
from basalt.operators import routing as W
from basalt.operators import understand as U
from basalt.operators import verify as V

VOCABULARY = [("transformer", 50), ("attention", 40), ("retrieval", 30), ("langchain", 20), ("langgraph", 20), ("graph", 60), ("embedding", 30), ("difference", 10), ("what", 90), ("is", 90), ("the", 90)]


def values(spark, rows, expr):
    return [r["y"] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(expr.alias("y")).collect()]


def test_spelling_of_texts(spark):
    vocab = spark.createDataFrame(VOCABULARY, "term string, freq bigint")
    asked = ["what si transformer", "teh lagraph", 'see https://attension.org/retrival and "retrival" in retrival_code, P-101, RETR', "Transformar ax transfrmr", "", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    got = {r["qid"]: (r["corrected"], r["changes"]) for r in U.correct_texts(rows, vocab, {"teh": "the", "si": "is"}).collect()}
    assert got[0] == ("what is transformer", 0) and got[1] == ("the langgraph", 1)
    assert got[2] == (asked[2], 0)  # protected spans
    assert got[3] == ("Transformer ax transformer", 2) and got[4] == ("", 0) and got[5] == ("", 0)


def test_decomposition_and_aspects(spark):
    got = values(spark, ["how is LangChain different from the LangGraph?", "X differs from Y", "between A1 and B2?", "tell me of pumps"], U.aspects(F.col("x")))
    assert got == [["LangChain", "LangGraph"], ["X", "Y"], ["A1", "B2"], []]
    parts = values(spark, ["compare pumps and valves"], U.decompose(F.col("x")))[0]
    assert parts == ["compare pumps and valves", "compare", "pumps", "valves", "compare pumps", "pumps definition purpose architecture", "valves definition purpose architecture", "pumps valves comparison difference"]


def test_facets_bind_names(spark):
    asked = spark.createDataFrame([(1, "comparison", "LangChain", "LangGraph"), (2, "reasoning", None, None), (3, "explanation", "pump", None)], "qid int, label string, a string, b string")
    told = spark.createDataFrame([(1, "LangGraph is unlike others"), (2, "The need for it; a traditional approach; it is faster"), (3, "direct words")], "qid int, text string")
    rows = U.facets(asked, told)
    assert {(r["qid"], r["facet"]): r["covered"] for r in rows.collect()} == {
        (1, "definition of LangChain"): False, (1, "definition of LangGraph"): True, (1, "differences"): True,
        (2, "problem or need"): True, (2, "prior approaches and limits"): True, (2, "proposed solution"): True, (2, "advantages"): True, (3, "direct evidence"): True}
    assert {r["qid"]: r["ratio"] for r in U.facet_ratio(rows).collect()} == {1: 0.667, 2: 1.0, 3: 1.0}


def test_names_context_and_style(spark):
    names = spark.createDataFrame([("attention",), ("multi-head attention",), ("graph",)], "name string")
    asked = spark.createDataFrame([(1, "what is multi-head attention in a Graph"), (2, "paragraphs")], "qid int, text string")
    assert {r["qid"]: r["entities"] for r in G.gazetteer(asked, names).collect()} == {1: ["multi-head attention", "graph"]}
    rows = spark.createDataFrame([("explain it in short", "attention"), ("how does that go", "pumps"), ("what of pumps", "pumps"), ("tell", None)], "q string, t string")
    assert [r["y"] for r in rows.select(G.resolve(F.col("q"), F.col("t")).alias("y")).collect()] == ["explain attention in short", "pumps how does that go", "what of pumps", "tell"]
    assert values(spark, ["explain attention in bullet points", "in bullet points"], G.strip_style(F.col("x"))) == ["explain attention", "in bullet points"]
    assert values(spark, ["“P–101”\u00a0 ﬁne "], G.normalise(F.col("x"), spark)) == ['"P-101" fine']
    assert values(spark, ["What is A1?"], G.subqueries(F.col("x"), F.array(F.lit("a"), F.lit("b")))) == [["What is a?", "What is b?", "a b difference comparison"]]


def test_extraction(spark):
    assert values(spark, ["on 2024-3-7.", "the 5 March 2023 report", "no date"], X.guess_date(F.col("x"))) == ["2024-03-07", "2023-03-05", ""]
    raw = ["Sure:\n```json\n[{\"a\": \"1\"}]\n```", 'It is {"a": "2"} so', "nothing", "[1, oops"]
    assert values(spark, raw, F.size(X.payload_rows(F.col("x")))) == [1, 1, 0, 0]
    docs = spark.createDataFrame([(1, "P-101 and FI-22, SOP-12. P-101 again. Root cause: wear. replaced BRG-204 x. downtime: 4.5 hours WO-77")], "doc int, text string")
    found = X.assets(docs, "doc", "text")
    assert [(r["asset"], r["type"], r["n"]) for r in found.orderBy("place").collect()] == [("P-101", "Equipment", 2), ("FI-22", "Instrument", 1)]
    e = X.events(docs, found, "doc", "text").where("asset = 'P-101'").collect()[0]
    assert (e["root_cause"], e["work_order"], e["parts_used"], e["downtime_hours"], e["confidence"]) == ("wear", "WO-77", ["BRG-204"], 4.5, 0.65)


def test_aspect_repair(spark):
    pool = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.6)], "qid long, doc long, score double")
    marks = spark.createDataFrame([(1, 10, 0, 2), (1, 11, 0, 2), (1, 13, 1, 2)], "qid long, doc long, pos int, total int")
    got = R.cover_aspects(pool.where("doc < 12"), pool, marks)
    assert sorted(r["doc"] for r in got.collect()) == [10, 13]
    assert sorted(r["doc"] for r in R.cover_aspects(pool.where("doc < 12"), pool, marks.where("pos = 0")).collect()) == [10, 11]


def test_model_slots_only_tighten(spark):
    claims = spark.createDataFrame([(1, 0, "the pump bearing failed after twelve hours")], "aid long, pos int, claim string")
    ev = spark.createDataFrame([(1, 5, "the pump bearing failed after twelve hours of work"), (1, 6, "valves")], "aid long, eid long, text string")
    plain = V.scored_claims(claims, ev).collect()[0]
    assert (plain["score"], plain["status"], plain["best"]) == (1.0, "SUPPORTED", 5)
    slot = lambda a, b: spark.createDataFrame([(1, 0, a, b)], "aid long, pos int, entail double, contradict double")
    assert V.scored_claims(claims, ev, entailment=slot(0.0, 0.95)).collect()[0]["score"] == 0.3
    assert V.scored_claims(claims, ev, entailment=slot(1.0, 0.0)).collect()[0]["score"] == 1.0
    weak = spark.createDataFrame([(1, 0, 5, 0.0)], "aid long, pos int, eid long, value double")
    assert V.scored_claims(claims, ev, semantic=weak).collect()[0]["score"] == 0.3


def test_conversation_store(spark):
    none = []
    log = [("a", 1, "create", "New conversation", none), ("a", 2, "append_user", "please explain pumps", ["P-1", "P-2"]), ("a", 3, "append", "They pump", ["P-2", "P-3"]), ("a", 4, "pin", None, none), ("a", 5, "link", "D1", none),
           ("b", 1, "create", "", none), ("b", 2, "rename", "  ", none), ("b", 3, "delete", None, none), ("c", 1, "create", "Mine", none), ("c", 2, "delete", None, none), ("c", 3, "create", "Mine 2", none)]
    got = {r["conv_id"]: r for r in D.conversation_store(spark.createDataFrame(log, "conv_id string, pos int, op string, value string, items array<string>")).collect()}
    assert set(got) == {"a", "c"} and got["c"]["title"] == "Mine 2" and got["c"]["messages"] == 0
    a = got["a"]
    assert (a["title"], a["pinned"], a["messages"], a["entities"], a["documents"]) == ("Explain pumps", True, 2, "P-1,P-2,P-3", "D1")


def test_curated_history(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"question {i} on pump seals and bearings" if i % 2 == 0 else "an answer on seals") for i in range(12)]
    got = C.curate(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).orderBy("place").collect()
    assert got[0]["text"].startswith(C.SUMMARY_HEAD + "\n1. question 0") and len(got) <= 10
    assert got[1]["text"].startswith("[Recalled") and [r["text"] for r in got[-2:]] == ["question 10 on pump seals and bearings", "an answer on seals"]


def test_gap_moves(spark):
    gaps = spark.createDataFrame([(1, "open", None), (2, "open", None)], "id int, status string, owner string")
    moves = spark.createDataFrame([(1, 1, "assign", "Ada"), (1, 2, "status", "captured"), (1, 3, "status", "lost"), (9, 1, "assign", "x")], "id int, pos int, action string, value string")
    assert {r["id"]: (r["status"], r["owner"]) for r in D.gap_move(gaps, moves).collect()} == {1: ("captured", "Ada"), 2: ("open", None)}


def test_update_streams_keep_the_last_rows(spark, tmp_path):
    from basalt.streaming import telemetry as S

    src = tmp_path / "src"
    for k in range(3):
        spark.createDataFrame([(1, k), (k + 10, k)], "user_id int, value int").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("user_id int, value int").option("maxFilesPerTrigger", 1).parquet(str(src)).groupBy("user_id").agg(F.count("*").alias("n"))
    got = S.drain(stream, "update", str(tmp_path / "w"), "user_id").collect()
    assert {r["user_id"]: r["n"] for r in got} == {1: 3, 10: 1, 11: 1, 12: 1}


def test_a_table_put_aside_is_found(spark, tmp_path):
    from basalt.sources import sinks as K

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k int, created_at string")
    K.upsert(rows, path, "k")
    (tmp_path / "t").rename(tmp_path / "t.old-x")  # a writer that stopped between its two renames
    K.upsert(spark.createDataFrame([(2, "b")], "k int, created_at string"), path, "k")
    assert {r["k"] for r in spark.read.parquet(path).collect()} == {1, 2}


def test_concepts_and_mentions(spark):
    chunks = ["RAG and MultiHeadAttention with Vector Store", "Vector Store uses RAG; Store the Vector", "see www.Site.com, x.from and fromMessages. The Next Step", "MultiHeadAttention"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(chunks)] + [(2, 0, "RAGs use LCEL now: MyStore and My Store")], "doc int, pos int, text string")
    got = {(r["doc"], r["concept"]): (r["df"], r["score"], r["place"]) for r in N.extract(rows).collect()}
    assert got == {(1, "Vector Store"): (2, 3.0, 1), (1, "MultiHeadAttention"): (2, 2.0, 2), (1, "RAG"): (2, 2.0, 3), (2, "LCEL"): (1, 1.0, 1), (2, "MyStore"): (1, 1.0, 2), (2, "RAGs"): (1, 1.0, 3)}
    told = spark.createDataFrame([(1, "vector store: a rag, not ragged"), (2, "Vector  store"), (3, "c++ and C++11, node.js"), (4, "élan vital, no délan vital"), (5, None), (6, "")], "k int, text string")
    names = spark.createDataFrame([("Vector Store",), ("RAG",), ("C++",), ("Node.js",), ("élan vital",), ("+x",)], "name string")
    found = {(r["k"], r["name"], r["at"]) for r in N.mentions(told, names).collect()}
    assert {(k, n) for k, n, _ in found} == {(1, "Vector Store"), (1, "RAG"), (3, "C++"), (3, "Node.js"), (4, "élan vital")}
    assert len([1 for k, n, _ in found if n == "C++"]) == 1  # a word must follow the sign
    assert {r["name"] for r in N.mentions(told.where("k = 3"), names, open_end=True).collect()} == {"C++", "Node.js"}
    tags = spark.createDataFrame([(1, "Is BERT used on P-101 or LangChain?")], "qid int, text string")
    assert G.gazetteer(tags, spark.createDataFrame([("LangChain",), ("BERT",)], "name string")).first()["entities"] == ["LangChain", "BERT", "P-101"]


def test_seeds_and_routes(spark):
    asked = spark.createDataFrame([(1, "how do llm agents use P-101?"), (2, "tell me of multi head attention"), (3, "Runnable things"), (4, "gpu"), (5, "attention all you need"), (6, "the 1bit model")], "qid int, text string")
    nodes = spark.createDataFrame([("P-101", "Equipment"), ("LLMs", "Concept"), ("MultiHead", "Concept"), ("RunnableLambda", "Concept"), ("GPUs", "Concept"), ("RAG", "Concept")], "id string, type string")
    ents = spark.createDataFrame([(1, "P-101"), (1, "P-999")], "qid int, entity string")
    got = {(r["qid"], r["seed"]): r["rules"] for r in W.graph_seeds(asked, ents, nodes).collect()}
    assert got == {(1, "P-101"): "entity", (1, "LLMs"): "word", (2, "MultiHead"): "inside+squeezed", (3, "RunnableLambda"): "inside", (4, "GPUs"): "word"}
    docs = spark.createDataFrame([(10, "d10", "Attention Is All You Need.pdf"), (11, "1_bit", ""), (12, "d12", "Pump manual"), (13, "d13", None)], "doc int, name string, title string")
    inside = spark.createDataFrame([(12, "P-101")], "doc int, entity string")
    of = spark.createDataFrame([("GPUs", 13), ("MultiHead", 13), ("LLMs", 13)], "concept string, doc int")
    best = spark.createDataFrame([(4, 12, 6.0), (4, 10, 3.0), (2, 12, 3.9)], "qid int, doc int, score double")
    routes = {(r["qid"], r["doc"]): r["rule"] for r in W.route(asked, ents, inside, docs, of, best).collect()}
    assert routes == {(1, 12): "entity", (5, 10): "title", (6, 11): "identifier", (2, 13): "concept"}  # 4: the corpus disagrees with the concept


def test_names_meet_by_whole_words_and_texts_are_read_once(spark):
    told = spark.createDataFrame([(1, "Pump Station Nord and pump house"), (2, "pump")], "k long, text string")
    names = spark.createDataFrame([(f"Pump {x}",) for x in ("Station", "Station Nord", "House", "Hall", "Room")] + [("Pump++",)], "name string")
    found = N.mentions(told, names)
    assert sorted((r["k"], r["name"], r["at"], r["span"]) for r in found.collect()) == [(1, "Pump House", 4, 2), (1, "Pump Station", 0, 2), (1, "Pump Station Nord", 0, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("key#" in line for line in plan.splitlines() if "Join" in line)
    rows = spark.createDataFrame([(1, i, "Vector Store uses RAG") for i in range(3)], "doc int, pos int, text string")
    assert "regexp_extract_all" not in N.extract(rows)._jdf.queryExecution().executedPlan().toString()
