from pyspark.sql import functions as F

from quillmark import api

CODE = 'import os\nimport hashlib\n\n\ndef f(x):\n    eval(x)\n    return hashlib.md5(x).hexdigest()\n\n\nf("a")\n'


def test_report(spark):
    rows = [(1, "a.py", "python", CODE), (2, "b.js", "javascript", 'el.innerHTML = x;\nvar y = "1";\n'), (3, "c.py", "python", "def broken(:\n"), (4, "d.py", "python", None), (5, "e.py", "python", "")]
    df = spark.createDataFrame(rows, "file_id long, path string, language string, code string")
    rep = {r.file_id: r for r in api.analyze(df).collect()}
    assert set(rep) == {1, 2, 3, 5}
    assert rep[1].high >= 2 and rep[1].status == "action_required" and rep[2].critical == 1 and rep[2].status == "critical"
    assert rep[5].status == "clean" and rep[5].score >= rep[1].score >= 0
    kinds = {(r.file_id, r.vuln_type) for r in api.security(df).collect()}
    assert {(1, "code_injection"), (1, "weak_crypto"), (2, "xss")} <= kinds and not {k for k in kinds if k[0] == 3}
    assert {r.kind for r in api.dead_code(df).collect()} == {"unused_import"}
    total = api.batch(df).first()
    assert total.files == 4 and total.critical_files == 1
    assert api.batch(df.limit(0)).first().files == 0
    some = spark.createDataFrame([(9, "f.py", "python", "password = 'Zk29fQ81xw'\ndef g(:\n")], df.schema)
    assert api.security(some).count() == 0 and api.security(some.withColumn("code", F.lit("password = 'Zk29fQ81xw'\n"))).count() == 1
    empty = {"clones", "refactoring", "performance", "dependencies", "taint"}  # nothing of theirs in these files
    for name, run in api.ANALYSES.items():
        rows = run(df).toPandas()
        assert bool(len(rows)) != (name in empty), name
        if "file_id" in rows.columns:
            assert set(rows.file_id) <= {1, 2, 3, 5}, name
