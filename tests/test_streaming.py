from conftest import pairs_of

from matchloom.operators import blocking
from matchloom.streaming.candidates import stream_candidates


def test_stream_against_a_static_index(spark, profiles, tmp_path):
    known = profiles({0: (0, {"n": "tom smith"}), 1: (0, {"n": "tom jones"}), 2: (0, {"n": "ann jones"})})
    profiles({10: (1, {"n": "jones, tom"}), 11: (1, {"n": "nobody"})}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(known.schema).parquet(str(tmp_path / "in"))
    q = stream_candidates(stream, blocking.token_blocking(known), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert pairs_of(out, "id", "candidate", "shared") == {(10, 0, 1), (10, 1, 2), (10, 2, 1)}
