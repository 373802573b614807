import pytest

from folioscope.sources import styles

NS = 'xmlns="http://purl.org/net/xbiblio/csl"'
LOCALE = f"""<locale {NS}><date form="text"><date-part name="day" suffix=" "/><date-part name="month" suffix=" "/><date-part name="year"/></date>
<terms><term name="and">and</term><term name="et-al">et al.</term><term name="no date" form="short">n.d.</term><term name="in">in</term><term name="open-quote">‘</term><term name="close-quote">’</term>
<term name="editor" form="short"><single>ed.</single><multiple>eds</multiple></term><term name="page" form="short"><single>p.</single><multiple>pp.</multiple></term>
<term name="month-05">May</term><term name="month-05" form="short">Mai.</term></terms></locale>"""
AUTHOR_DATE = f"""<style {NS} class="in-text"><macro name="year"><choose><if variable="issued"><date variable="issued"><date-part name="year"/></date></if><else><text term="no date" form="short"/></else></choose></macro>
<macro name="who"><names variable="author"><name name-as-sort-order="all" initialize-with="." and="text" sort-separator=", "/><label form="short" prefix=" (" suffix=")"/><substitute><names variable="editor"/><text variable="title" font-style="italic"/></substitute></names></macro>
<bibliography et-al-min="4" et-al-use-first="1"><sort><key macro="who"/><key macro="year"/></sort><layout suffix="."><group delimiter=" "><text macro="who"/><text macro="year" prefix="(" suffix=")"/>
<choose><if type="article-journal"><group delimiter=", "><text variable="title" quotes="true"/><text variable="container-title" font-style="italic"/><group><text variable="volume"/><text variable="issue" prefix="(" suffix=")"/></group><group delimiter=" "><label variable="page" form="short"/><text variable="page"/></group></group></if>
<else><group delimiter=". "><text variable="title" font-style="italic"/><group delimiter=": "><text variable="publisher-place"/><text variable="publisher"/></group></group></else></choose></group></layout></bibliography></style>"""
CAPITALS = f"""<style {NS} class="in-text"><bibliography et-al-min="3" et-al-use-first="1" name-delimiter="; "><layout suffix="."><names variable="author" suffix=". "><name name-as-sort-order="all" sort-separator=", "/></names>
<text variable="title" font-weight="bold" text-case="capitalize-first"/><group prefix=". " delimiter=", "><text variable="publisher" text-case="uppercase"/><date variable="issued" form="text"/></group></layout></bibliography></style>"""
NOTES = f"""<style {NS} class="note"><locale xml:lang="en"><terms><term name="open-quote">“</term><term name="close-quote">”</term></terms></locale><bibliography><layout suffix="."><group delimiter=", ">
<names variable="author translator" delimiter="; "><name name-as-sort-order="first" and="text" delimiter-precedes-last="always"/></names><choose><if type="book" match="none"><text variable="title" quotes="true"/></if><else-if variable="title"><text variable="title" font-style="italic" strip-periods="true"/></else-if></choose>
<group delimiter=" "><text term="in"/><text variable="container-title" font-style="italic"/></group><choose><if is-numeric="edition"><text variable="edition" suffix=" edn"/></if><else><text variable="edition"/></else></choose>
<date variable="issued" delimiter="-"><date-part name="year"/><date-part name="month" form="numeric-leading-zeros"/></date><text variable="DOI" prefix="doi:"/></group></layout></bibliography></style>"""
SCHEMA = "id int, type string, text map<string, string>, names map<string, array<struct<family: string, given: string, literal: string>>>, dates map<string, array<int>>"
BOOK, ARTICLE, BARE, MANY = 1, 2, 3, 4
ITEMS = [
    (BOOK, "book", {"title": "on Sound & Sense.", "publisher": "Press", "publisher-place": "Porto", "edition": "2"}, {"author": [("Doe", "Jane Mary", None), ("Roe", "R.", None)]}, {"issued": [1999, 5, 3]}),
    (ARTICLE, "article-journal", {"title": "Early <fugues>", "container-title": "Journal", "volume": "12", "issue": "3", "page": "10-25", "DOI": "10.1/x"}, {"author": [("Bach", "J. S.", None), (None, None, "The Group"), ("Poe", "E", None)]}, {"issued": [2001]}),
    (BARE, "book", {"title": "Nobody"}, {}, {}),
    (MANY, "book", {"title": "Many"}, {"editor": [("A", "B", None), ("C", "D", None), ("E", "F", None), ("G", "H", None)]}, {"issued": [1800, 5]}),
]
WANT = {
    ("author-date", "text"): ["Doe, J.M. and Roe, R. (1999) on Sound & Sense. Porto: Press.", "Bach, J.S., The Group, and Poe, E. (2001) ‘Early <fugues>’, Journal, 12(3), pp. 10-25.", "Nobody (n.d.) Nobody.", "A, B. et al. (eds) (1800) Many."],
    ("author-date", "html"): ["Doe, J.M. and Roe, R. (1999) <i>on Sound &amp; Sense.</i> Porto: Press.", "Bach, J.S., The Group, and Poe, E. (2001) ‘Early &lt;fugues&gt;’, <i>Journal</i>, 12(3), pp. 10-25.", "<i>Nobody</i> (n.d.) <i>Nobody</i>.", "A, B. et al. (eds) (1800) <i>Many</i>."],
    ("capitals", "text"): ["Doe, Jane Mary; Roe, R. On Sound & Sense. PRESS, 3 May 1999.", "Bach, J. S. et al. Early <fugues>. 2001.", "Nobody.", "Many. May 1800."],
    ("capitals", "html"): ["Doe, Jane Mary; Roe, R. <b>On Sound &amp; Sense.</b> PRESS, 3 May 1999.", "Bach, J. S. et al. <b>Early &lt;fugues&gt;</b>. 2001.", "<b>Nobody</b>.", "<b>Many</b>. May 1800."],
    ("notes", "text"): ["Doe, Jane Mary, and R. Roe, on Sound & Sense, 2 edn, 1999-05.", "Bach, J. S., The Group, and E Poe, “Early <fugues>”, in Journal, 2001, doi:10.1/x.", "Nobody.", "Many, 1800-05."],
    ("notes", "rtf"): [r"Doe, Jane Mary, and R. Roe, {\i on Sound & Sense}, 2 edn, 1999-05.", r"Bach, J. S., The Group, and E Poe, “Early <fugues>”, in {\i Journal}, 2001, doi:10.1/x.", r"{\i Nobody}.", r"{\i Many}, 1800-05."],
}
STYLES = {"author-date": AUTHOR_DATE, "capitals": CAPITALS, "notes": NOTES}


@pytest.mark.parametrize("style,markup", WANT)
def test_entries(spark, style, markup):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    got = styles.Style(STYLES[style], LOCALE, markup).bibliography(items)
    assert got.columns == [*items.columns, "entry", "sort_keys"]
    assert [r.entry for r in got.orderBy("id").collect()] == WANT[style, markup]


def test_order_and_folder(spark, tmp_path):
    (tmp_path / "a.csl").write_text(AUTHOR_DATE, encoding="utf-8")
    (tmp_path / "locales-en-US.xml").write_text(LOCALE, encoding="utf-8")
    found = styles.styles_in(str(tmp_path))
    assert list(found) == ["a"]
    got = styles.Style(found["a"], LOCALE).bibliography(spark.createDataFrame(ITEMS, SCHEMA))
    assert [r.id for r in got.orderBy("sort_keys").collect()] == [MANY, ARTICLE, BOOK, BARE]
    with pytest.raises(ValueError):
        styles.Style(f"<style {NS}/>")


def test_nulls_and_empty_items(spark):
    items = spark.createDataFrame([(1, None, None, None, None), (2, "book", {}, {"author": []}, {"issued": []}), (3, "book", {"title": " "}, {"author": None}, {"issued": None})], SCHEMA)
    got = styles.Style(NOTES, LOCALE).bibliography(items).orderBy("id").collect()
    assert [r.entry for r in got] == [None, None, None]
