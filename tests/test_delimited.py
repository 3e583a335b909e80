from dataclasses import replace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curveloom.sources import delimited as D
from curveloom.sources.files import PointFile, read_points, read_probe, read_ratings, write_points

CONF = "file_id int, read_header boolean, id_field string, category_field string, field_sep string, n_columns int, column_names array<string>"


def plain(line, sep):
    """One character at a time: fields, or None if quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            out = ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < n and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            j = n if j < 0 else j
            out, i = line[i:j], j
            if '"' in out:
                return None
        fields.append(out)
        if i >= n:
            return fields
        i += 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a1",\t ', max_size=40), min_size=1, max_size=8), st.booleans())
def test_tokenizer_against_plain(lines, tab):
    sep = "\t" if tab else ","
    error, fields, first, start, stop = D.tokenize([x.encode() for x in lines], np.full(len(lines), ord(sep), np.uint8))
    data = "\n".join(lines) + "\n"
    for k, line in enumerate(lines):
        want = plain(line, sep)
        assert (error[k] < 0) == (want is not None), line
        if want is not None:
            raw = [data[start[i] : stop[i]] for i in range(first[k], first[k] + fields[k])]
            assert [r[1:-1].replace('""', '"') if r.startswith('"') else r for r in raw] == want


def test_states_across_chunks():
    long = '"' + "a,b" * 1000 + '",2'
    error, fields, *_ = D.tokenize([long.encode(), b"1,2", ('"' + "x" * 2000).encode()], np.full(3, 44, np.uint8))
    assert fields[0] == 2 and fields[1] == 2 and error.tolist() == [-1, -1, 0]


def test_reasons(spark):
    conf = spark.createDataFrame([(1, True, "ID", "kind", "comma", 4, ["Kind", "id", "x", "y"]), (2, False, "ROWNUM", "?", "tab", 2, None), (3, None, None, None, None, None, None)], CONF)
    rows = [
        (1, 1, "Kind,id,x,y"), (1, 2, 'a,7,1,2\r'), (1, 2, 'a,7,1,2\r'), (1, 3, '"b ""q"", c",8, 3 ,"4"'), (1, 4, "a,  ,1,2"), (1, 5, "a,9,1"), (1, 6, 'a,9,1,"2'), (1, 7, 'a,9,1,2"'), (1, 8, "# x"), (1, 9, " \t "), (1, 10, ""),
        (1, 11, "a,9,1,-2"), (1, 12, "a,9,1,2147483648"), (1, 13, "a,9,1,02147483647"), (1, 14, 'a,9,"1" ,2'), (1, 15, None), (None, 16, "a,9,1,2"), (9, 1, "a"), (2, 1, "5\t6"), (2, 2, "5\t"), (2, 3, "\r\r"), (1, 17, ",9,1,2"),
    ]
    lines = spark.createDataFrame([(*r, "extra") for r in rows], "file_id int, line_no bigint, raw_line string, line string")
    got = {(r.file_id, r.line_no): r for r in D.parse_lines(lines, conf).collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {(1, 4): "value", (1, 5): "columns", (1, 6): "quoting", (1, 7): "quoting", (1, 11): "value", (1, 12): "value", (1, 14): "quoting", (2, 2): "value", (2, 3): "columns"}
    assert (got[1, 3].id, got[1, 3].category, got[1, 3].coords) == ("8", 'b "q", c', [3, 4])
    assert got[1, 13].coords == [1, 2147483647] and (got[2, 1].id, got[2, 1].category, got[2, 1].coords) == ("1", None, [5, 6])
    assert got[1, 6].offset == 6 and got[1, 17].category == "" and (1, 15) not in got and (1, 1) not in got and (1, 10) not in got
    assert D.parse_lines(lines.where("false"), conf).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,x,y,Class\n" + "".join(f"p{i},{i},{i + 1},c{i % 2}\n" for i in range(50)) + "bad,1\n")
    good, bad = read_points(spark, str(tmp_path / "p.csv"), PointFile("ID", "class"))
    assert good.count() == 50 and [(r.line_no, r.reason) for r in bad.collect()] == [(52, "columns")]
    write_points(good, str(tmp_path / "out"), 2)
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["id", "category", "col0", "col1"] and back.count() == 50
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.txt").write_text("1:\n10,3,2005-01-01\n11,4,2005-01-02\n")
    assert sorted((r.movie, r.user, r.rating) for r in read_ratings(spark, str(tmp_path / "r")).collect()) == [(1, 10, 3), (1, 11, 4)]
    (tmp_path / "probe.txt").write_text("1:\n10\n11\n2:\n12\n")
    assert sorted((r.movie, r.user) for r in read_probe(spark, str(tmp_path / "probe.txt")).collect()) == [(1, 10), (1, 11), (2, 12)]


def test_cli(spark, tmp_path):
    from curveloom import cli, datagen
    from curveloom.config import Classifier, Config, Density, Index

    x, y = datagen.gaussian_clusters(3, 10, (40, 60), seed=4)
    (tmp_path / "p.csv").write_text("id,cat," + ",".join(f"x{i}" for i in range(10)) + "\n" + "".join(f"{i},{c}," + ",".join(map(str, p)) + "\n" for i, (p, c) in enumerate(zip(x.tolist(), y.tolist(), strict=True))))
    c = Config(input=str(tmp_path / "p.csv"), data=PointFile("id", "cat"), index=Index(max_trials=8), classifier=Classifier(exact_distance=True), density=Density(skip=True))
    c.write(str(tmp_path / "c.json"))
    assert Config.read(str(tmp_path / "c.json")) == c
    out, score = cli.cluster(spark, c)
    assert out.count() == len(x) and score > 0.9
    split, _ = cli.cluster(spark, replace(c, density=Density(mergeable_shrinkage=0.9)))
    both = split.select("id", F.split("label", "-")[0].alias("of"), "label").join(out.select("id", F.col("label").alias("whole")), "id")
    assert split.count() == len(x) and both.where("of <> cast(whole as string)").count() == 0  # parts refine clusters
    assert [cli.command(t) for t in ("a", "--Cluster", "r", "assemble", "", "-v", "define", "h")] == ["assess", "cluster", "recluster", "help", "help", "version", "define", "help"]
    assert cli.assess(spark, c).first().points == len(x)


def test_records_over_lines(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('id,cat,x,y\n1,"x\ny",3,4\n2,"open,5,6\n3,b,7,8\n# a "note\n4,"c ""d\n\n# e",9,10\r\n5,f,11,z\n6,"g\n')
    good, bad = read_points(spark, str(f), PointFile("id", "cat"))
    assert {(r.line_no, r.id, r.category, tuple(r.coords)) for r in good.collect()} == {(2, "1", "x\ny", (3, 4)), (5, "3", "b", (7, 8)), (7, "4", 'c "d\n\n# e', (9, 10))}
    assert {(r.line_no, r.reason) for r in bad.collect()} == {(4, "quoting"), (10, "value"), (11, "quoting")}


def test_records_across_splits(spark, tmp_path):
    """Against one pass over the file: many records of one to four lines, splits of 200 bytes."""
    rng, text, want, line = np.random.default_rng(3), "", set(), 1
    for i in range(400):
        n = int(rng.integers(0, 4)) if i % 3 == 0 else 0
        cat = "a" if not n else '"' + "\n".join(rng.choice(["b", 'c""', ",d", "#"], n + 1)) + '"'
        text += f"{i},{cat},{i % 7}\n"
        want.add((line, i))
        line += 1 + n
    (tmp_path / "p.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        good, bad = read_points(spark, str(tmp_path / "p.csv"), PointFile("1", "2", read_header=False))
        assert {(r.line_no, int(r.id)) for r in good.collect()} == want and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_standard_input(spark, monkeypatch):
    import io
    import sys

    monkeypatch.setattr(sys, "stdin", io.StringIO('id,cat,x\n1,"a\nb",3\n2,c,x\n'))
    good, bad = read_points(spark, "-", PointFile("id", "cat"))
    assert [(r.line_no, r.category, r.coords) for r in good.collect()] == [(2, "a\nb", [3])] and [(r.line_no, r.reason) for r in bad.collect()] == [(4, "value")]
    monkeypatch.setattr(sys, "stdin", io.StringIO(""))
    assert read_points(spark, "-")[0].count() == 0
