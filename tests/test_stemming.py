from pyspark.sql import functions as F

from veriframe.functions.stemming import english_tokens, stem
from veriframe.operators import chunking, retrieval

#: Words and stems of the algorithm's published examples.
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll""".split()


def test_published_examples():
    assert {w: stem(w) for w in EXAMPLES[::2]} == dict(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    assert [stem(w) for w in ("é", "x1ing", "by")] == ["é", "x1ing", "by"]


def test_analysis_and_search(spark):
    df = spark.createDataFrame([("a", "The Doctor's treatments aren't treating it."), ("b", "Nothing of the sort"), ("c", None), ("d", "")], "chunk_id string, text string")
    got = {r.chunk_id: r.t for r in df.select("chunk_id", english_tokens(F.col("text")).alias("t")).collect()}
    assert got == {"a": ["doctor", "treatment", "aren't", "treat"], "b": ["noth", "sort"], "c": None, "d": []}
    terms = chunking.tokenised(df.filter("text IS NOT NULL"), english_tokens)
    asked = spark.createDataFrame([("q", "was the treated doctor")], "query_id string, query string")
    assert [r.chunk_id for r in retrieval.bm25_top_k(asked, terms, 3, analyse=english_tokens).collect()] == ["a"]
