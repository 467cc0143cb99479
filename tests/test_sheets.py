import datetime as dt
import os
import zipfile
from decimal import Decimal

import pytest

from larkspur.sources import sheets, tables


@pytest.fixture
def source(spark):
    sheets.register(spark)
    return spark


HARD = ["plain", "", None, " spaces  kept ", "line\nbreak\r\n", "tab\there", "<a & 'b' \"c\">", "_x0041_ literal", "\x01\x1f", "日本語 🎈", "=1+1", "x" * 32_767]


def test_round_trip(source, tmp_path):
    path = f"file://{tmp_path}/book"
    schema = "id int, text string, price double, big long, money decimal(20,2), yes boolean, day date, at timestamp"
    rows = [(i, t, 1.5 * i, 10**15 + i, Decimal("12.30"), i % 2 == 0, dt.date(2024, 2, 1 + i), dt.datetime(2024, 2, 1, 12, 30, i)) for i, t in enumerate(HARD)] + [(None,) * 8]
    source.createDataFrame(rows, schema).repartition(3).write.format("sheet").mode("append").option("rows", 3).save(path)
    back = source.read.format("sheet").load(path)
    assert back.columns == schema.replace(" int", "").split(", ")[:1] + [c.split()[0] for c in schema.split(", ")[1:]]
    got = {r["id"]: r for r in back.collect()}
    assert len(got) == len(HARD)  # the row of nulls is an empty row, which goes
    for i, t in enumerate(HARD):
        r = got[str(i)]
        assert r["text"] == t and float(r["price"]) == 1.5 * i and r["big"] == str(10**15 + i) and r["money"] == "12.3" and r["yes"] == str(i % 2 == 0).lower()
        assert r["day"] == f"2024-02-{1 + i:02d}" and r["at"] == f"2024-02-01 12:30:{i:02d}"
    assert not [f for f in os.listdir(tmp_path / "book") if f.startswith("_")]
    source.createDataFrame([(1, "new")], "id int, text string").write.format("sheet").mode("overwrite").save(path)
    assert [tuple(r) for r in source.read.format("sheet").load(path).collect()] == [("1", "new")]
    source.createDataFrame([(2, "more")], "id int, text string").write.format("sheet").mode("append").save(path)
    assert source.read.format("sheet").load(path).count() == 2


def test_empty_tables_and_failures(source, tmp_path):
    empty = f"file://{tmp_path}/empty"
    source.createDataFrame([], "a string, b int").write.format("sheet").mode("append").save(empty)
    back = source.read.format("sheet").load(empty)
    assert back.columns == ["a", "b"] and back.count() == 0
    with pytest.raises(Exception, match="32767 characters"):
        source.createDataFrame([("x" * 32_768,)], "a string").write.format("sheet").mode("append").save(f"file://{tmp_path}/long")
    assert source.read.format("sheet").schema("a string").load(f"file://{tmp_path}/long").count() == 0
    with pytest.raises(Exception, match="cells hold texts"):
        source.createDataFrame([([1],)], "a array<int>").write.format("sheet").mode("append").save(f"file://{tmp_path}/bad")


def foreign(path, rows, shared, links="", rels="", sheet2=None):
    """A workbook as an office program writes it: shared texts, styles, several sheets."""
    parts = dict(sheets.STATIC_PARTS)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{sheets.MAIN}" xmlns:r="{sheets.OFFICE}"><sheets><sheet name="Master" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId9"/></sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", '<Relationship Id="rId9" Type="x" Target="/xl/worksheets/other.xml"/></Relationships>')
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{sheets.MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;dm&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{sheets.MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>"
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{sheets.MAIN}" xmlns:r="{sheets.OFFICE}"><sheetData>{rows}</sheetData>{links}</worksheet>'
    parts["xl/worksheets/other.xml"] = f'<worksheet xmlns="{sheets.MAIN}"><sheetData>{sheet2 or ""}</sheetData></worksheet>'
    if rels:
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = f'<Relationships xmlns="{sheets.PACKAGE}/relationships">{rels}</Relationships>'
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_foreign_workbooks(source, tmp_path):
    shared = ["<t>Name</t>", "<t>When</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh>"]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>Size</t></is></c><c r="AB1" t="inlineStr"><is><t>NAME</t></is></c></row>'
    rows = head + '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3" s="1"><v>45323</v></c><c r="AA3" s="2"><v>2.50</v></c></row><row r="4"><c r="A4"/></row>'
    rows += '<row r="5"><c r="A5" t="e"><v>#N/A</v></c><c r="C5" t="str"><v>f</v></c><c r="AA5" t="b"><v>1</v></c></row>'
    foreign(tmp_path / "a.xlsx", rows, shared, '<hyperlinks><hyperlink ref="A3" r:id="r1"/></hyperlinks>', '<Relationship Id="r1" Type="x" Target="https://x.com/p"/>', "<row><c><v>7</v></c></row><row><c><v>8.5</v></c></row>")
    path = f"file://{tmp_path}/a.xlsx"
    assert [tuple(r) for r in source.read.format("sheet").load(path).collect()] == [("rich text", "2024-02-01", "2.5"), (None, "f", "true")]
    assert source.read.format("sheet").option("links", "true").load(path).first()["Name"] == "rich text\nhttps://x.com/p"
    other = source.read.format("sheet").option("sheet", "Other").load(path)
    assert other.columns == ["7"] and [r[0] for r in other.collect()] == ["8.5"]
    with pytest.raises(Exception, match="no sheet"):
        source.read.format("sheet").option("sheet", "None").load(path).collect()


def test_items_of_a_workbook(source, tmp_path):
    head = ["WishlistItem", "Product", "Product specifications", "Search Keywords", "Location", "Priority", "Quantity Needed", "Open to used", "Target Price", "Is Bulk Option", "Bulk Keywords", "Only Check Primary Links", "Product URLs", "GTIN/UPC", "Brand"]
    rows = [
        ("1", " Glow Lamp ", '50 in; 50 inch; 50"; 4 in 1; !Lite', "RAYG1US1BLK; cosy; 036000291452; !lite; !Pro", "Hall", "5", "2.0", "yes", "$40", "Yes", "2Pack; 4", "yes", "see https://x.com/p?utm_source=a), https://x.com/p", "12345; 4006381333931", "Acme"),
        ("2", "Desk", None, None, None, None, "x", None, None, "yes", None, "Yes", None, None, None),
        ("3", "Chair", None, None, "garage", "1", None, "no", None, None, "8", None, None, None, None),
        ("4", "  ", None, None, None, "9", None, None, None, None, None, None, None, None, None),
    ]
    path = f"file://{tmp_path}/master"
    source.createDataFrame(rows, ", ".join(f"`{h}` string" for h in head)).coalesce(1).write.format("sheet").mode("append").save(path)
    known = source.createDataFrame([("1", "glow LAMP", ["04006381333931", "00000000000017"], ["m-10"], "Other"), ("2", "renamed", ["00000000000017"], ["x"], "y")], "wid string, product string, gtins array<string>, mpns array<string>, brand string")
    items = tables.load_items(source.read.format("sheet").load(path), known)
    got = {r["wid"]: r for r in items.collect()}
    a, b, c = got["1"], got["2"], got["3"]
    assert len(got) == 3 and a["product"] == "Glow Lamp" and a["specs"] == ["50 inch", "4 in 1"] and a["exclude"] == ["Lite", "lite", "Pro"]
    assert a["skus"] == ["RAYG1US1BLK", "036000291452"] and a["keywords"] == ["cosy"] and a["gtins"] == ["00000000000017", "00036000291452", "04006381333931"]
    assert a["mpns"] == ["m-10"] and a["brand"] == "Acme" and a["bulk_sizes"] == [2, 4] and a["packs"] == [1, 2, 4] and a["qty_needed"] == 2 and a["target"] == 40.0
    assert a["urls"] == ["https://x.com/p"] and a["only_links"] and not a["links_only_fallback"] and a["priority"] == 5
    assert b["packs"] is None and b["gtins"] == [] and b["brand"] == "" and not b["only_links"] and b["links_only_fallback"] and b["priority"] == 3 and b["qty_needed"] == 1
    assert c["packs"] == [1] and not c["open_used"]

    seen = source.createDataFrame([("1", dt.datetime(2024, 3, 1)), ("1", dt.datetime(2024, 1, 1)), ("2", dt.datetime(2024, 2, 1))], "wid string, dt timestamp")
    chosen = lambda **k: [r["wid"] for r in tables.select_items(items, **k).collect()]
    assert chosen() == ["1", "2", "3"] and chosen(min_priority=3) == ["1", "2"] and chosen(wids=["3", "1"]) == ["1", "3"] and chosen(limit=1) == ["1"]
    assert chosen(locations=["HALL", "gar"]) == ["1", "3"] and chosen(locations=["attic"]) == []
    assert chosen(history=seen, cadence={5: 7}, now=dt.datetime(2024, 3, 7)) == ["2", "3"]
    assert chosen(history=seen, cadence={5: 7}, now=dt.datetime(2024, 3, 7, 12)) == ["1", "2", "3"]  # half a day of grace
