"""Scans, sinks, manifests, the model hook and the stream."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from plotline.operators import answering as N
from plotline.sources import clips as C
from plotline.sources import rows as R
from plotline.sources import tables as T
from plotline.streaming import route as H


def test_clip_files_with_three_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Movie,clip_id,start,end,sentence,dialogue\nM,c1,0,2,"He says ""hi"", then leaves.",\n,c2,2,4,no movie,\nM,c3,4,6,,\nM,,8.5,9,Third,\n', encoding="utf-8")
    (tmp_path / "b.TSV").write_text("video_id\tcaption\tstart_time\nN\tOne\t\nN\tTwo\t3\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jsonl").write_text('{"imdb": "O", "text": "x", "start": 1, "end": 2.5}\n\n[1]\n{"imdb": "O", "description": "", "text": "y"}\n{"imdb": "O", "text": "z"}\n', encoding="utf-8")
    (tmp_path / "d.txt").write_text("movie,text\nP,no\n")
    got = {(r["movie"], r["clip_id"], r["sequence_index"], r["text"]) for r in C.scan_clips(spark, str(tmp_path)).collect()}
    assert got == {
        ("M", "c1", 0, 'He says "hi", then leaves.'), ("M", "M__8p5_9", 3, "Third"), ("N", "N__00000", 0, "One"), ("N", "N__00001", 1, "Two"),
        ("O", "O__1_2p5", 0, "x"), ("O", "O__00002", 2, "z"),
    }
    one = C.scan_clips(spark, str(tmp_path / "a.csv"))
    assert one.count() == 2
    assert C.movie_slice(one, "M", 1, ["sequence_index"]).first()["clip_id"] == "c1"
    with pytest.raises(ValueError):
        C.scan_clips(spark, [])


def test_row_numbers_go_through_input_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("movie,text\n" + "".join(f"m,line {i:05d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = C.scan_clips(spark, str(tmp_path / "big.csv"))
        assert rows.filter(F.col("text") == F.format_string("line %05d", F.col("sequence_index"))).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_may_differ_in_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("movie,text\nm,x\n")
    (tmp_path / "b c.CSV").write_text("text,movie\ny,m\nz,m\n")
    (tmp_path / "empty.csv").write_text("")
    got = {(r["movie"], r["text"], r["sequence_index"]) for r in C.scan_clips(spark, str(tmp_path)).collect()}
    assert got == {("m", "x", 0), ("m", "y", 0), ("m", "z", 1)}


@pytest.mark.parametrize("name,content", [("a.csv", "movie,text\nm,x\n"), ("a.TSV", "movie\ttext\nm\tx\n"), ("a.jsonl", '{"movie": "m", "text": "x"}\n')])
def test_a_folder_with_one_type(spark, tmp_path, name, content):
    (tmp_path / name).write_text(content)
    assert [(r["movie"], r["text"]) for r in C.scan_clips(spark, str(tmp_path)).collect()] == [("m", "x")]


def test_json_rows(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "a"}\n\n{"id": \n[1]\n')
    assert sorted(r["malformed"] for r in R.tolerant_lines(spark, str(path)).collect()) == [False, True, True]
    bad = R.tolerant_lines(spark, str(path), numbered=True).filter("malformed").orderBy("line")
    assert [r["line"] for r in bad.collect()] == [3, 4]
    with pytest.raises(Exception, match=r"r.jsonl:[34]: invalid JSON object"):
        R.strict_lines(spark, str(path)).collect()
    for name, payload in (("list.json", [{"id": "a"}]), ("data.json", {"data": [{"id": "a"}]})):
        (tmp_path / name).write_text(json.dumps(payload, indent=1))
        assert [tuple(r) for r in R.json_document(spark, str(tmp_path / name), "id: string").collect()] == [("a",)]
    rows = spark.createDataFrame([("é", None, ["x"])], "id string, v int, l array<string>")
    assert R.write_json(rows, str(tmp_path / "out")) == 1
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"id": "é", "v": None, "l": ["x"]}
    R.write_audit_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["l"] == '["x"]'


def test_required_columns(spark):
    rows = spark.createDataFrame([("m", "", "x"), ("", "", "y"), ("m", "c", "z")], "movie string, clip_id string, audio_description string")
    assert [r[0] for r in rows.select(R.first_empty_column(rows)).collect()] == ["clip_id", "clip_id", None]
    assert R.missing_columns(rows.drop("movie")) == ["movie"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.bin", digest, "3"), ("b.bin", digest, "3")], "name string, sha256 string, size string")
    facts = R.file_facts(spark, str(tmp_path))
    assert {r["name"]: r["errors"] for r in R.manifest_errors(manifest, facts).collect()} == {"a.bin": [], "b.bin": ["file does not exist"]}
    wrong = spark.createDataFrame([("a.bin", "0", "4")], "name string, sha256 string, size string")
    assert R.manifest_errors(wrong, facts).first()["errors"] == ["sha256 mismatch", "size mismatch"]
    fields = spark.createDataFrame([("f", "a"), ("g", "z")], "field string, file_id string")
    assert [r["field"] for r in R.dangling_references(fields, spark.createDataFrame([("a",)], "file_id string")).collect()] == ["g"]


def test_model_hook_retries_once(spark):
    prompts = spark.createDataFrame([("a", ["w", "x", "y", "z"], [3, 2, 1, 0], 3), ("b", ["w", "x", "y", "z"], [0, 1, 2, 3], 0)],
                                    "id string, options array<string>, option_order array<int>, answer_idx int")

    def model(batch):
        return batch["id"].map({"a": '{"prediction_idx": 0}', "b": "no idea"})

    got = {r["id"]: (r["prediction_idx"], r["correct"], r["run_name"], r["error"]) for r in N.ask_with_retry(prompts, model, "run").collect()}
    assert got == {"a": (3, True, "run", None), "b": (None, False, "run_retry", "no JSON object found in model output")}


def test_stream_adds_only_what_is_new(spark, tmp_path):
    source_dir, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, v int"

    def put(rows, name):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source_dir)

    def route(batch):
        return batch.withColumn("route", F.when(F.col("v") > 1, "selected").otherwise("rejected"))

    put([("a", 1), ("b", 2)], "1")
    stream = lambda: spark.readStream.schema(schema).parquet(source_dir)
    H.route_stream(spark, stream(), route, out, str(tmp_path / "ck")).awaitTermination()
    put([("c", 3), ("a", 9)], "2")
    H.route_stream(spark, stream(), route, out, str(tmp_path / "ck")).awaitTermination()
    # A lost checkpoint replays everything; nothing is written twice.
    H.route_stream(spark, stream(), route, out, str(tmp_path / "ck-new")).awaitTermination()
    assert {(r["id"], r["route"]) for r in spark.read.parquet(out).collect()} == {("a", "rejected"), ("b", "selected"), ("c", "selected")}
    got = {r["route"]: r["n"] for r in H.progress(spark, out, 4).collect()}
    assert got == {"rejected": 1, "selected": 2, "remaining": 1}


def test_stream_replays_and_expires(spark, tmp_path, monkeypatch):
    """The first row by order stays; a batch written again replaces itself; ids older than the expiry count as new."""
    source_dir, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    now = [1_000_000]
    monkeypatch.setattr(H.time, "time", lambda: now[0])

    def put(rows):
        spark.createDataFrame(rows, "id string, v int").repartition(2).write.mode("append").parquet(source_dir)

    def run(checkpoint, **more):
        def route(batch):
            return batch.withColumn("route", F.when(F.col("v") > 4, "kept").otherwise("odd"))

        stream = spark.readStream.schema("id string, v int").parquet(source_dir)
        H.route_stream(spark, stream, route, out, checkpoint, order=["v"], **more).awaitTermination()

    rows = lambda: sorted(((r["id"], r["v"]) for r in spark.read.parquet(out).collect()), key=str)
    put([("a", 7), ("a", 3), ("b", 9), ("a", 5), ("c", 1), (None, 2)])
    run(check)
    assert rows() == sorted([("a", 3), ("b", 9), ("c", 1), (None, 2)], key=str)
    # The commit of the batch is lost, so the same batch runs again.
    for name in (tmp_path / "ck" / "commits").iterdir():
        name.rename(tmp_path / f"lost-{name.name}")
    run(check)
    assert rows() == sorted([("a", 3), ("b", 9), ("c", 1), (None, 2)], key=str)
    assert {r["route"]: r["n"] for r in H.progress(spark, out).collect()} == {"kept": 1, "other": 3}
    now[0] += 10 * H.SLOT
    put([("b", 1), ("d", 8)])
    run(check, expiry=20 * H.SLOT)
    assert len(rows()) == 5
    now[0] += 30 * H.SLOT
    put([("b", 2)])
    run(check, expiry=20 * H.SLOT)
    assert [r for r in rows() if r[0] == "b"] == [("b", 2), ("b", 9)]
    assert {r["route"]: r["n"] for r in H.progress(spark, out, 10).collect()} == {"kept": 2, "other": 4, "remaining": 4}


def test_many_headers_make_one_plan(spark, tmp_path):
    """Three hundred files with ten headers; a scan per layout, whatever the number of files."""
    heads = [["movie", "text", "start"], ["text", "movie", "start"], ["x", "start", "movie", "text"], ["Movie_ID", "caption", "start_time"], ["imdb", "y", "z", "sentence", "start"],
             ["start", "description", "video_id"], ["text", "text", "movie", "start"], ["movie", "", "text", "start"], ["MOVIE", "Text", "START"], ["id", "movie", "text", "start", "end"]]
    want = set()
    for k in range(300):
        names = heads[k % 10]
        lines = [",".join(names)]
        for row in range(2):
            value = {"start": str(row), "text": f'"line {k}, ""{row}"""', "movie": f"m{k}"}
            value |= {"start_time": value["start"], "sentence": value["text"], "description": value["text"], "caption": value["text"], "imdb": value["movie"], "video_id": value["movie"], "movie_id": value["movie"]}
            lines.append(",".join(value.get(n.lower(), f"q{row}") for n in names))
            want.add((f"m{k}", row, f'line {k}, "{row}"', str(row)))
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
    rows = C.scan_clips(spark, str(tmp_path))
    assert {(r["movie"], r["sequence_index"], r["text"], r["timestamp_start"]) for r in rows.collect()} == want
    few = C.scan_clips(spark, str(tmp_path / "f0.csv"))
    shape = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert shape(rows) == shape(few)


def test_odd_delimited_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffmovie,text,video\r\nm,"a, ""b""",v\r\n\r\nm,5" disk,v\r\nm,short\r\nm,"unclosed,v\r\nm,,v\r\nm,"""q""",\r\n', encoding="utf-8")
    got = [(r["sequence_index"], r["text"], r["video_path"]) for r in C.scan_clips(spark, str(tmp_path)).orderBy("sequence_index").collect()]
    assert got == [(0, 'a, "b"', "v"), (1, '5" disk', "v"), (2, "short", None), (3, '"unclosed', "v"), (5, '"q"', None)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "m.csv").write_text('text,movie\n"one\ntwo ""x""\n",m\nthree,m\n"a\n\nb",m\n')
    got = [(r["sequence_index"], r["text"]) for r in C.scan_clips(spark, str(tmp_path / "b"), multi_line=True).orderBy("sequence_index").collect()]
    assert got == [(0, 'one two "x"'), (1, "three"), (2, "a b")]
    assert C.scan_clips(spark, str(tmp_path), suffixes={"txt": "csv"}).collect() == []


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    rng = random.Random(3)
    contents = {"a": b"x" * 50, "b": b"\xef\xbb\xbfmark\nmore than a few bytes of text here\n", "c": b"\n" * 60, "d": b"\xef\xbb\xbf" + b"y" * 70, "e": bytes(rng.randrange(256) for _ in range(200_000)), "small": b"s", "none": b"",
                "f": b"\r\n".join(b"line %d" % i for i in range(9000)), "g": b"no end" * 9000, "z.gz": gzip.compress(b"packed" * 100, mtime=0) * 3}
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {r["name"]: (r["actual_size"], r["actual_sha256"]) for r in R.file_facts(spark, str(tmp_path), whole_bytes=40).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}


def test_text_source_file_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("start,end,alpha,ground_truth,beta-2,movie,vid\n144.104,148.433, He runs. ,He ran.,,SIGNS,x\n1,2,,,\"b, c\",1005_Signs,y\n", encoding="utf-8-sig")
    rows = T.read_text_sources(spark, str(path), ["alpha", "beta-2"]).orderBy("r_start").collect()
    assert [(r["key"], r["r_start"], r["source"], r["text"], r["ground_truth"]) for r in rows] == [
        ("signs", 1.0, "beta-2", "b, c", ""), ("signs", 144.104, "alpha", "He runs.", "He ran.")]
    with pytest.raises(ValueError):
        T.read_text_sources(spark, str(path), ["gamma"])


def test_split_and_route_sinks(spark, tmp_path):
    row = {"id": "x", "movie": "m", "target_clip_id": "c", "target_sentence": "t", "context_clip_ids": ["a"], "context_sentences": ["s"], "question_type": "q",
           "question": "?", "options": ["o"], "predictability": "p", "expectedness": 0.5, "target_type": "y", "evidence_clip_ids": ["a"], "answer_idx": 0, "answer_text": "o"}
    rows = spark.createDataFrame([row])
    T.write_splits(rows, F.lit("train"), str(tmp_path / "s"))
    public = spark.read.json(str(tmp_path / "s" / "public"))
    private = spark.read.json(str(tmp_path / "s" / "private"))
    assert public.first()["split"] == "train_public" and "answer_idx" not in public.columns
    assert private.first()["split"] == "train_private" and private.first()["answer_source"]["source"] == "target_sentence"
    T.write_routed(rows.select("id", F.lit("kept").alias("route")), str(tmp_path / "r"))
    assert (tmp_path / "r" / "route=kept").is_dir()


def test_white_space_of_any_kind_is_stripped(spark):
    from plotline.functions import scalars as S
    from plotline.functions import text as X
    from plotline.operators import selection as P

    rows = spark.createDataFrame([("keep\n", "\nHe runs", " 　M\t")], "flag string, sentence string, movie string")
    got = rows.select(S.loose_bool(F.col("flag")), P.needs_antecedent(F.col("sentence")), X.strip(F.col("movie"))).first()
    assert tuple(got) == (True, True, "M")


def test_text_behind_a_json_object_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"movie": "m", "text": "x"} trailing\n')
    with pytest.raises(Exception, match="invalid JSON"):
        C.scan_clips(spark, str(tmp_path / "a.jsonl")).collect()
