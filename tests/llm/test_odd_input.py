"""What every operator and stage takes without a crash: malformed UTF-8, nulls everywhere, its own helper names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe, fingerprint, langid, licenses, lines, manifest, mil, packing, pii, quality_rules, secret_scan, simhash

#: Names that operators use inside.
OWN = "_row _owner _drops _n_lines _n_dropped _redacted _words _h5 _bands _hits _place _tie _group _last row key fp owner batch kept score ids slice".split()

OPERATORS = {
    "licenses": licenses.scan,
    "licenses, joined": lambda docs: licenses.scan(docs, inline=0),
    "langid": lambda docs: langid.identify(docs, langid.fit(docs)),
    "quality_rules": quality_rules.judge,
    "packing": packing.pack,
    "fingerprint": fingerprint.compare_with_edit,
    "mil": lambda docs: mil.score(docs, mil.fit(docs, docs.select("doc_id", F.lit(1).alias("label")))),
    "pii": pii.find_pii,
    "bpe": bpe.encode_decode,
    "lines": lines.drop_frequent_lines,
    "secret_scan": secret_scan.find_secrets,
    "manifest": lambda docs: manifest.manifest(manifest.leaf_digests(docs)),
    "simhash": simhash.near_duplicates,
} | {f"stage {name}": lambda docs, f=stage: f(docs.sparkSession, docs, "") for name, stage in corpus_pipeline.STAGES}
#: Those that give other rows than one for each of theirs.
OTHER_ROWS = {"licenses", "licenses, joined", "packing", "stage packing", "stage quality_rules", "stage near_dedup"}


@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"word{i}" for i in range(30))
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, None, None, None, None), (None, prose + "\nx", None, "s", None), (2, "", "de", None, 0), (3, None, "de", "s", 5), (4, "漢字 😀 \x00", "xx", "s", 2)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bad = spark.sql(f"select 5L doc_id, cast(concat(X'FF61', cast(' a@b.co {prose}' as binary), X'C3') as string) text, 'en' lang, 's' source, 9L n_chars")
    return plain.union(bad).withColumns({n: F.lit(f"own {n}") for n in OWN})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_takes_it(docs, name):
    out = OPERATORS[name](docs)
    got = out.collect() if "text" not in out.columns else out.withColumn("text", F.hex(F.col("text").cast("binary"))).collect()
    assert name in OTHER_ROWS or len(got) == docs.count()
    if name.startswith("stage") and name != "stage packing":
        assert out.columns == docs.columns and all(r[n] == f"own {n}" for r in got for n in OWN)
    assert OPERATORS[name](docs.limit(0)).count() == 0
