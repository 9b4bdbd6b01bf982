import glob
import gzip
import hashlib

from tablewright.llm.warc import archive_and_audit, audit, cut_records, manifest, merkle_levels, read_archives, records, write_archives


def pages_of(spark, n=300):
    rows = [(i, f"http://h{i % 3}/{i}", f"<p>é {i}\r\n\r\nWARC/1.1\r\n\r\n" + "x" * (i % 50), "extra") for i in range(n)]
    rows += [(None, None, None, "extra"), (9001, "u\r\nv", "", "extra"), (7, "http://h1/7", rows[7][2], "extra")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive string")


def test_archives_are_sound(spark):
    pages = pages_of(spark)
    got = archive_and_audit(pages, per_archive=40, fan=4, levels=2).collect()
    assert len(got) == 303 and all(r.intact for r in got)
    assert len({r.archive for r in got}) > 3
    for a in {r.archive for r in got}:
        end = 0
        for r in sorted((r for r in got if r.archive == a), key=lambda r: r.record_no):
            assert r.record_offset == end
            end += r.record_length
    assert archive_and_audit(pages.limit(0)).count() == 0


def test_damage_is_located(spark, tmp_path):
    made = records(pages_of(spark), per_archive=40)
    folder = str(tmp_path / "warc")
    write_archives(made, folder)
    want = manifest(made).cache()
    mine = merkle_levels(want, 4, 3)
    assert audit(mine, merkle_levels(read_archives(spark, folder), 4, 3), 4).count() == 0
    first, second, third = sorted(glob.glob(f"{folder}/archive=*/part*"))[:3]
    number = lambda f: int(f.split("archive=")[1].split("/")[0])
    data = bytearray(gzip.decompress(open(first, "rb").read()))
    spans = list(cut_records(bytes(data)))
    data[spans[4][1] - 5] ^= 1
    open(first, "wb").write(gzip.compress(bytes(data)))
    whole = gzip.decompress(open(second, "rb").read())
    cut = list(cut_records(whole))
    open(second, "wb").write(gzip.compress(whole[: cut[-1][0]]))
    open(third, "wb").write(b"junk")
    for crc in glob.glob(f"{folder}/archive=*/.*.crc"):
        open(crc, "wb").write(b"")
    import os

    for crc in glob.glob(f"{folder}/archive=*/.*.crc"):
        os.remove(crc)
    found = {(r.archive, r.record_no): r for r in audit(mine, merkle_levels(read_archives(spark, folder), 4, 3), 4).collect()}
    assert (number(first), 4) in found and sum(a == number(first) for a, _ in found) == 1
    lost = [r for (a, _), r in found.items() if a == number(second)]
    assert len(lost) == 1 and lost[0].in_mine and not lost[0].in_theirs
    assert sum(a == number(third) for a, _ in found) == want.where(f"archive = {number(third)}").count()


def test_copies_of_a_row_are_spread(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}", "x") for i in range(300)] + [(7, "http://h/7", "<p>7", "x")] * 150
    rows += [(None, None, None, "x")] * 150
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(5)
    got = archive_and_audit(pages, per_archive=20, fan=4, levels=2).collect()
    assert len(got) == 600 and all(r.intact for r in got)
    by_archive = {}
    for r in got:
        by_archive.setdefault(r.archive, []).append(r)
    assert max(map(len, by_archive.values())) <= 80
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    for found in by_archive.values():
        assert sorted(r.record_no for r in found) == list(range(len(found)))
        assert len({r.archive_root for r in found}) == 1
    # The root covers every record, those beyond fan^levels too.
    a, found = next((a, f) for a, f in by_archive.items() if len(f) > 16)
    level = [(r.record_offset, r.record_offset + r.record_length, r.record_sha256) for r in sorted(found, key=lambda r: r.record_no)]
    depth = 0
    while depth < 2 or len(level) > 1 or 4**depth < max(map(len, by_archive.values())):
        level = [level[k : k + 4] for k in range(0, len(level), 4)]
        join = lambda c: hashlib.sha256(",".join(f"{s}:{e}:{h}" for s, e, h in c).encode()).hexdigest()
        level = [(c[0][0], c[-1][1], join(c)) for c in level]
        depth += 1
    assert level[0][2] == found[0].archive_root
