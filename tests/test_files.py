import email
import io
import re
import zipfile
from email.message import EmailMessage
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkveil.cli import main
from sparkveil.operators import ner
from sparkveil.operators.detect import detect
from sparkveil.config import Config
from sparkveil.plans import files as runs
from sparkveil.plans.engine import Engine
from sparkveil.sources import documents, files, pages
from sparkveil.vault import TABLES
from sparkveil.plans.tables import ordered, shared_folder
from sparkveil.streaming.incremental import VaultVersions, anonymize_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ORIGINALS = ("Novák", "Kováčov", "905 123", "800315", "novak@")


def word_file() -> bytes:
    body = (
        "<w:p><w:r><w:t>Predávajúci: Ing. Ján </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>Nov</w:t></w:r><w:r><w:t>ák, r. č. 800315/1233</w:t></w:r></w:p>"
        "<w:p><w:r><w:t>Pán Novák &amp; syn</w:t><w:tab/></w:r><w:del w:author=\"Ján Novák\"><w:r><w:delText>tel. 0905 123 456</w:delText></w:r></w:del></w:p>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="mailto:jan.novak@example.sk" TargetMode="External"/></Relationships>')
        z.writestr("docProps/core.xml", "<cp:coreProperties><dc:title>Zmluva: pán Novák</dc:title><dc:creator>Ján Novák</dc:creator></cp:coreProperties>")
    return out.getvalue()


def mail(docx: bytes) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Zmluva: pán Novák", "jan.novak@example.sk", "x@y.sk"
    m["Received"], m["X-Originating-IP"] = "from 1.2.3.4", "1.2.3.4"
    m["X-Original-To"], m["X-Topic"] = "jan.novak@example.sk", "notes"
    m.set_content("Dobrý deň,\nvolal pán Novák, tel. 0905 123 456\n")
    m.add_alternative('<p>Volal pán <b>Novák</b></p><!-- c -->píšte <a href="mailto:jan.novak@example.sk">sem</a>', subtype="html")
    m.add_attachment(docx, maintype="application", subtype="vnd.docx", filename="zmluva_pan_Novak.docx")
    m.add_attachment(b"\x89PNG", maintype="image", subtype="png", filename="x.png")
    return m.as_bytes()


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "in"
    (where / "sub").mkdir(parents=True)
    (where / "a.txt").write_bytes("Ing. Ján Novák\r\nNováka, tel. 0905 123 456".encode())
    (where / "b.docx").write_bytes(word_file())
    (where / "sub" / "c.eml").write_bytes(mail(word_file()))
    (where / "d.csv").write_bytes("pán Novák;č".encode("cp1250"))
    (where / "x.report.json").write_text("{}")
    (where / "e.pdf").write_bytes(b"%PDF")
    (where / "f.bin").write_bytes(b"x")
    return where


def plain(name: str, data: bytes) -> str:
    if name.endswith(".docx"):
        z = zipfile.ZipFile(io.BytesIO(data))
        return "\n".join(z.read(n).decode() for n in z.namelist())
    if name.endswith(".eml"):
        m = email.message_from_bytes(data, policy=email.policy.default)
        parts = [p for p in m.walk() if not p.is_multipart()]
        return "\n".join([*map(str, m.values()), *(plain(p.get_filename() or "x.txt", p.get_payload(decode=True)) for p in parts), *(p.get_filename() or "" for p in parts)])
    return data.decode()


def test_collect(spark, folder):
    rows = files.collect(spark, [str(folder / "f.bin"), str(folder)]).orderBy("doc_seq").collect()
    assert [r["name"] for r in rows] == ["f.bin", "a.txt", "b.docx", "d.csv", "e.pdf", "c.eml"]
    with pytest.raises(FileNotFoundError):
        files.collect(spark, [str(folder / "none")])


def test_anonymize_and_restore(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setenv("VEIL_PASSPHRASE", "correct horse battery")
    out, back = tmp_path / "out", tmp_path / "back"
    assert main(["anonymize", str(folder), "-o", str(out), "--mode", "reversible"], spark) == 1  # the PDF has no backend, and is told so
    assert not (out / "e_anonym.pdf").exists()
    for p in out.iterdir():
        if p.suffix != ".json":
            text = plain(p.name, p.read_bytes())
            assert not any(o in text for o in ORIGINALS), p.name
    sent = email.message_from_bytes((out / "c_anonym.eml").read_bytes())
    assert sent["Received"] is None and sent["X-Originating-IP"] is None and "PNG" not in str(sent)
    assert sent["X-Original-To"].startswith("[EMAIL_") and sent["X-Topic"] == "notes"
    assert 'xml:space="preserve">[OSOBA' in plain("b.docx", (out / "b_anonym.docx").read_bytes()).replace("Predávajúci: ", "")
    assert "Novák" not in (out / "a_anonym.report.json").read_text()
    monkeypatch.setenv("VEIL_PASSPHRASE", "wrong")
    with pytest.raises(Exception):
        main(["restore", str(out / "a_anonym.txt"), "-o", str(back), "--vault", str(out / "vault.json")], spark)
    monkeypatch.setenv("VEIL_PASSPHRASE", "correct horse battery")
    main(["restore", str(out / "a_anonym.txt"), str(out / "b_anonym.docx"), str(out / "c_anonym.eml"), "-o", str(back), "--vault", str(out / "vault.json")], spark)
    assert (back / "a_obnovene.txt").read_bytes() == (folder / "a.txt").read_bytes()
    words = lambda d: ["".join(x[2] for x in p) for p in documents._word_paragraphs(zipfile.ZipFile(io.BytesIO(d)).read("word/document.xml").decode())]
    assert words((back / "b_obnovene.docx").read_bytes()) == words(word_file())
    body = lambda d: email.message_from_bytes(d, policy=email.policy.default).get_body(("plain",)).get_content()
    assert body((back / "c_obnovene.eml").read_bytes()) == body(mail(word_file()))


def test_selftest_and_scan(spark, folder, capsys):
    assert main(["selftest"], spark) == 0
    assert main(["scan", str(folder / "a.txt")], spark) == 0
    assert "Ing. Ján Novák" in capsys.readouterr().out
    assert main(["entities"]) == 0


def test_decoding(spark):
    rows = [b"\xef\xbb\xbfa\xc4\x8d", "č ž".encode("cp1250"), b"\x81\xe8", b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, content binary")
    assert [r["t"] for r in df.select("i", files.decoded(F.col("content")).alias("t")).orderBy("i").collect()] == ["ač", "č ž", "\x81č", ""]


def test_upload_names(spark):
    df = spark.createDataFrame([(0, "x/a.txt"), (1, "a.txt"), (2, "b")], "doc_seq long, name string")
    assert [r["name"] for r in files.unique_names(df).orderBy("doc_seq").collect()] == ["a.txt", "a (2).txt", "b"]


def test_spans_over_segments():
    segs, joiners = ["ab", "cd", "ef"], ["\n", "", "\n"]
    assert documents.replaced([2, 2, 2], segs, joiners, [{"start": 1, "end": 6, "token": "[X]"}]) == ["a[X]", "", "f"]
    assert documents.replaced([2, 2, 2], segs, joiners, [{"start": 2, "end": 4, "token": "[X]"}]) == ["ab", "[X]d", "ef"]


def test_page_lines_and_text(spark):
    words = spark.createDataFrame([(1, "b", 30.0, 10.0, 40.0, 20.0), (1, "a", 0.0, 11.0, 20.0, 21.0), (1, "c", 0.0, 40.0, 9.0, 50.0)], "page int, word string, x0 double, top double, x1 double, bottom double")
    assert pages.page_text(pages.with_lines(words)).first()["text"] in ("b a\nc", "a b\nc")
    assert pages.needs_ocr("auto", 5, 0.0) and not pages.needs_ocr("never", 0, 1.0)
    assert pages.ocr_languages("slk+eng", ["slk"]) == "slk" and pages.ocr_languages("slk", []) == "eng"


def test_stream_numbers_as_one_batch(spark, tmp_path):
    schema = "doc_seq long, unit_seq int, text string"
    texts = ["pán Novák, a@b.sk", "Nováka, c@d.sk", "a@b.sk a pani Malá"]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, 0, t)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got: dict[int, str] = {}
        query = anonymize_stream(Engine(spark), spark.readStream.schema(schema).parquet(str(tmp_path / "in")), VaultVersions(spark, str(tmp_path / "vault")), lambda df, n: got.update({r["doc_seq"]: r["text"] for r in df.collect()}), str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
        assert list(got) == [i]
        whole = Engine(spark).anonymize(spark.createDataFrame([(k, 0, x) for k, x in enumerate(texts)], schema), "reversible") if i == 2 else None
        if whole:
            assert {r["doc_seq"]: r["text"] for r in whole.units.collect()}[2] == got[2]


def test_units_of_a_unit_do_not_mix(spark):
    df = spark.createDataFrame([(0, 0, "tel."), (0, 1, "0905 123 456")], "doc_seq long, unit_seq int, text string")
    assert [s["score"] for r in detect(df, Config()).orderBy("unit_seq").collect() for s in r["spans"]] == [0.75]


def test_intake(spark):
    df = spark.createDataFrame([(0, "c:\\x\\a.txt", bytearray(b"1")), (1, "a.txt", bytearray(b"2")), (2, "k.vault", bytearray(b"")), (3, "p.exe", bytearray(b""))], "doc_seq long, name string, content binary")
    assert [(r["name"], r["kind"], r["error"]) for r in files.intake(df).orderBy("doc_seq").collect()] == [("a.txt", "file", None), ("a (2).txt", "file", None), ("k.vault", "vault", None), ("p.exe", "file", "unsupported format")]


def test_archive(spark, tmp_path):
    (tmp_path / "a.txt").write_text("pán Novák, a@b.sk, c@d.sk")
    runs_before = set(Path(shared_folder(spark).removeprefix("file://")).rglob("run-*"))
    out, findings, _ = runs.anonymize_files(spark, [str(tmp_path / "a.txt")], "irreversible")
    assert set(Path(shared_folder(spark).removeprefix("file://")).rglob("run-*")) == runs_before  # nothing with originals is left
    runs.archive(out, findings, str(tmp_path / "o.zip"))
    z = zipfile.ZipFile(tmp_path / "o.zip")
    assert z.namelist() == ["a_anonym.txt", "protokol.txt"]
    assert z.read("protokol.txt").decode() == "a.txt\n  EMAIL: 2\n  OSOBA: 1\nSpolu\n  spolu: 3\n  EMAIL: 2\n  OSOBA: 1"


def test_pdf_originals(spark, tmp_path):
    import hashlib

    (tmp_path / "e_anonym.pdf").write_bytes(b"new")
    empty = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
    vault = empty | {"originals": spark.createDataFrame([(hashlib.sha256(b"new").hexdigest(), bytearray(b"old"))], TABLES["originals"])}
    row = runs.restore_files(spark, [str(tmp_path / "e_anonym.pdf")], vault).first()
    assert (row["name"], bytes(row["content"]), row["restored"], row["error"]) == ("e_obnovene.pdf", b"old", -1, None)


def test_model_plug_in(spark):
    def factory():
        return lambda text: [(m.start(), m.end(), "B-LOC", 0.9) for m in re.finditer("Bratislava|Mesto", text)]

    df = spark.createDataFrame([(0, 0, "V meste Bratislava - Mesto. " + "x " * 1000 + "Bratislava")], "doc_seq long, unit_seq int, text string")
    cfg = Config.of({"engine": "rules+ner", "entities": {"enable": ["LOKALITA"]}})
    assert [r["text"] for r in Engine(spark, cfg, factory).scan(df).orderBy("start").collect()] == ["Bratislava - Mesto", "Bratislava"]
    with pytest.raises(files.BackendUnavailable):
        Engine(spark, cfg).scan(df)
    assert [ner.entity_of(x) for x in ("B-PER", "LABEL_3", "I-GPE", "O", "LABEL_9")] == ["OSOBA", "ORGANIZACIA", "LOKALITA", None, None]
    text = "a b\n" * 700 + "c" * 3000
    assert "".join(c for _, c in ner.chunks(text)) == text and max(len(c) for _, c in ner.chunks(text)) <= ner.CHUNK


def test_ordered_numbers_by_ranges(spark):
    rows = [(k % 3, f"p{k * 7919 % 1000:04d}") for k in range(1000)]
    got = ordered(spark.createDataFrame(rows, "arg int, path string").repartition(5), ["arg", "path"], "n").orderBy("n").collect()
    assert [(r["arg"], r["path"], r["n"]) for r in got] == [(*r, n) for n, r in enumerate(sorted(rows))]
    assert ordered(spark.createDataFrame([], "arg int, path string"), ["arg", "path"], "n").count() == 0
