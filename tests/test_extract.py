from __future__ import annotations

import pytest

from menuspark.extract import hours, menu, prices, printed
from menuspark.extract.html import annotated_lines, visible_lines


def page(body: str) -> str:
    return f"<html><body>{body}</body></html>"


def test_visible_lines():
    html = page("<script>x</script><h2>A &amp; <b>B</b></h2><p>one<br>two</p><ul><li>l1<li>l2</ul><table><tr><td>c1</td><td>c2</td></tr></table><div class='w-condition-invisible'>no</div>")
    assert visible_lines(html) == ["A & B", "one", "two", "l1", "l2", "c1 c2"]
    assert annotated_lines(html)[0] == ("A & B", 2)
    assert visible_lines(None) == visible_lines("") == []


@pytest.mark.parametrize(("text", "want"), [("kr 225", 22500), ("fra 95,-", 9500), ("1.250", 125000), ("22,50", None), ("99999", None), ("abc", None)])
def test_price_lines(text, want):
    found = prices.read_line(text)
    assert (found.minor if found else None) == want


def test_linked_data_wins():
    items = menu.extract(page('<script type="application/ld+json">{"@graph":[{"@type":["MenuItem"],"name":"1. Ramen","offers":[{"price":249,"priceCurrency":"nok"}]}]}</script><script type="application/ld+json">{broken</script><p>Noise 100</p>'))
    assert [(i.name, i.price_minor, i.method, i.confidence, i.currency) for i in items] == [("Ramen", 24900, "json_ld", 0.99, "NOK")]


def test_names_that_end_in_prices():
    items = menu.extract(page("<p>Dinner Tuesday - Saturday 17.00 - 21.30</p><p>Tartar av okse, steinsopp og kantareller (e,sn,su) 265</p><p>Ricotta dumplings med trøffel 295,-</p>"))
    assert [(i.name, i.price_minor) for i in items] == [("Tartar av okse", 26500), ("Ricotta dumplings med trøffel", 29500)]


def test_prices_on_their_own_line_and_shared_sections():
    items = menu.plain_items(menu.Page(page("<h3>Chicken Burger</h3><p>Allergens: wheat</p><p>259 kr</p><h3>1. Tenders</h3><p>kr 35,00</p>")))
    assert [(i.name, i.price_minor, i.confidence) for i in items] == [("Chicken Burger", 25900, 0.72)]
    shared = menu.plain_items(menu.Page(page("<p>Ramen 260,-</p><h3>SHOYU RAMEN</h3><p>broth</p><h3>SPICY MISO RAMEN</h3><p>more</p><h3>Menyforklaring</h3>")))
    assert [(i.name, i.section, i.price_minor, i.description) for i in shared] == [("SHOYU RAMEN", "Ramen", 26000, "broth"), ("SPICY MISO RAMEN", "Ramen", 26000, "more")]


def test_shared_sections_of_any_length():
    names = [f"DISH {chr(65 + n // 26)}{chr(65 + n % 26)}" for n in range(40)]
    lines = ["Platter 250,-", *[x for name in names for x in (name, "with rice")], "Contact", "AFTER THE MENU", "AND MORE"]
    general, whole = menu.shared_sections(lines), menu.shared_sections(lines, reach=None)
    assert [i.name for i in general[0]] == names[:15]  # the surveyed rule: 30 lines
    assert [(i.name, i.section, i.price_minor, i.description) for i in whole[0]] == [(name, "Platter", 25000, "with rice") for name in names]
    two = menu.shared_sections([*lines[:81], "Bowl 150,-", *lines[1:81]], reach=None)
    assert [(at, len(own), own[0].section) for at, own in two.items()] == [(0, 40, "Platter"), (81, 40, "Bowl")]


def test_headings_under_drinks_do_not_count():
    body = "<h2>Mat</h2>" + "".join(f"<h3>Rett {c}</h3><p>{100 + n} kr</p>" for n, c in enumerate("abcd")) + "<h2>Drikke</h2><h3>Eplemost</h3><p>45 kr</p><h3>Husets glass</h3><p>95 kr</p>"
    assert [i.name for i in menu.heading_items(menu.Page(page(body)))] == ["Rett a", "Rett b", "Rett c", "Rett d"]
    assert "Husets glass" not in [i.name for i in menu.extract(page(body))]


def test_same_name_in_two_sections_has_two_identities():
    body = "".join(f"<h2>{s}</h2><h3>Biff</h3><p>{p} kr</p><h3>{s} suppe</h3><p>99 kr</p>" for s, p in (("Lunsj", 150), ("Middag", 250)))
    items = menu.heading_items(menu.Page(page(body)))
    assert sorted((i.name, i.section, i.price_minor) for i in items if i.name == "Biff") == [("Biff", "Lunsj", 15000), ("Biff", "Middag", 25000)]


def test_wrapped_from_and_first_cards():
    wrapped = page("".join(f"<p>{p} kr</p><p>Dish {p}</p><p>note</p><p>{p} kr</p>" for p in (110, 120, 130)))
    assert [(i.name, i.description) for i in menu.wrapped_items(menu.Page(wrapped))] == [("Dish 110", "note"), ("Dish 120", "note"), ("Dish 130", "note")]
    found = menu.from_items(menu.Page(page("<p>Taco fra 89,-</p><p>Burrito</p><p>fra kr 1.250</p>")))
    assert [(i.name, i.price_minor, i.price_kind) for i in found] == [("Taco", 8900, "from"), ("Burrito", 125000, "from")]
    assert [(i.name, i.price_minor) for i in menu.first_cards(menu.Page(page("<p>Supper (3)</p><p>Tom Yum</p><p>149</p><p>Next</p><p>99</p>")))] == [("Tom Yum", 14900)]


def test_embedded_and_cards():
    rows = ",".join(f'{{"id":"{n}","name":"Rett {n}","price":{9000 + n}}}' for n in range(5))
    script = f'<script type="application/json">{{"x":[{{"categories":[{{"name":"Popular","item_ids":["0"]}},{{"name":"Mat","item_ids":["0","1","2","3"]}},{{"name":"Drinks","item_ids":["4"]}}],"items":[{rows}]}}]}}</script>'
    assert [(i.name, i.section, i.method) for i in menu.extract(page(script))] == [(f"Rett {n}", "Mat", "api") for n in range(4)]
    card = lambda name, price: f'<div data-testid="menu-product"><b data-testid="menu-product-name">{name}</b><span data-testid="menu-product-price"><s data-testid="menu-product-price-before-discount">kr 300</s>{price}</span></div>'
    section = lambda title, cards: f'<div data-testid="menu-category-section"><h2 data-testid="menu-category-section-title">{title}</h2>{cards}</div>'
    body = section("Mat", card("A", "fra 139 kr") + card("B", "149 kr") + card("C", "150")) + section("Dessert", card("Is", "95,-")) + section("Drikke", card("Brus", "45"))
    assert [(i.name, i.section, i.price_minor, i.price_kind) for i in menu.extract(page(body))] == [("A", "Mat", 13900, "from"), ("B", "Mat", 14900, "exact"), ("C", "Mat", 15000, "exact"), ("Is", "Dessert", 9500, "exact")]


def test_no_items_from_contact_lines():
    assert menu.extract(page("<p>Opening Hours</p><p>Tuesday-Friday</p><p>16-22</p><p>Contact</p><p>90226090</p>")) == []
    assert menu.extract(None) == []


def test_rows_in_spark(spark):
    df = spark.createDataFrame([(1, page("<p>Ramen 249,-</p>"), 5), (2, None, 6), (3, "", 7)], "pid long, html string, position int")
    found = menu.extract_items(df, "pid", "html").collect()
    assert [(r.pid, r.name, r.price_minor) for r in found] == [(1, "Ramen", 24900)]


def test_printed_menus():
    items = printed.printed_items(["PRIMI PIATTI", "Pasta carbonara 260", "Guanciale, pecorino og egg", "BAMBINI For barn opp til 12 år", "Pasta carbonara h, m, e 125", "SIGNATUR", "KAENG PHET GAI", "195 / 229", "Kylling", "MAKI", "SPICY 125 / 135", "TUNA MAKI", "1. Ris 55 2. Nudler 65"])
    assert [(i.name, i.section, i.price_minor, i.price_max_minor) for i in items] == [
        ("Pasta carbonara", "PRIMI PIATTI", 26000, None), ("Pasta carbonara", "BAMBINI", 12500, None), ("KAENG PHET GAI", "SIGNATUR", 19500, 22900),
        ("SPICY TUNA MAKI", "MAKI", 12500, 13500), ("Ris", "MAKI", 5500, None), ("Nudler", "MAKI", 6500, None),
    ]
    assert items[0].key != items[1].key and items[2].price_kind == "multiple"
    assert printed.lines_from_fragments([("Ris", 0, 10, 20), ("55", 25, 10, 10), ("Te", 0, 14, 10), ("X", 300, 14, 5)]) == ["Ris 55", "Te", "X"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>Fri-Mon 11-22</p>", [(1, 660, 1320), (5, 660, 1320), (6, 660, 1320), (7, 660, 1320)]),
        ("<p>Dinner Tuesday - Wednesday 5pm - late</p><p>Kitchen closes at 21:30</p>", [(2, 1020, 1290), (3, 1020, 1290)]),
        ("<p>Hours</p><p>Sat, Sun 12-23</p><p>Kitchen closes 30 minutes before closing</p>", [(6, 720, 1350), (7, 720, 1350)]),
        ("<p>Hours</p><p>Fri 11-01</p><p>Kitchen closes at 23:00</p>", [(5, 660, 1380)]),
        ("<p>Mandag: 16.00 - 22.00 (kjøkkenet stenger 21)</p>", [(1, 960, 1260)]),
        ("<p>Mandag 00:00 - 00:00</p>", [(1, 0, 0)]),
    ],
)
def test_hours(body, want):
    assert [(i.weekday, i.opens, i.closes) for i in hours.kitchen_hours(page(body))] == want


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("<p>Dinner Tuesday - Saturday 17 - late</p>", "AMBIGUOUS_CLOSE_TIME"),
        ("<p>nothing</p>", "NO_HOURS_FOUND"),
        ("<p>Hours A</p><p>Mon 10-12</p><p>Hours B</p><p>Mon 10-13</p>", "AMBIGUOUS_HOURS_SECTION"),
        ("<p>Mon 10-12</p><p>Kitchen closes 20 min before</p><p>Kitchen closes 30 min before</p>", "AMBIGUOUS_RELATIVE_KITCHEN_CUTOFF"),
        ("<p>Mon 12-22</p><p>Kitchen closes at 11</p>", "INVALID_GLOBAL_KITCHEN_CUTOFF"),
    ],
)
def test_hours_errors(body, code):
    with pytest.raises(hours.HoursError) as e:
        hours.kitchen_hours(page(body))
    assert e.value.code == code


def test_hours_scope_hint():
    body = page("<p>Hours Grünerløkka</p><p>Mon 10-12</p><p>Hours Sentrum</p><p>Mon 10-13</p>")
    assert [i.closes for i in hours.kitchen_hours(body, ["sentrum"])] == [780]


def test_numbered_and_block_readings():
    rows = menu.Page(page("<h2>Mat</h2><p>1. Ramen (e,m)</p><p>god suppe</p><p>149,-</p><p>Ekstra</p><p>Egg</p><p>45 kr</p><p>2) Gyoza</p><p>dumplings 95,-</p><h2>Kontakt</h2><p>3. Nei</p><p>99,-</p>")).annotated
    items = menu.numbered_items(menu.food_scope(rows))
    assert [(i.name, i.price_minor, i.description, i.confidence) for i in items] == [("Ramen", 14900, "god suppe", 0.92), ("Gyoza", 9500, "dumplings", 0.92)]
    body = "".join(f"<h3>Rett {c}</h3><p>En lang og god beskrivelse</p><p>{p} kr</p>" for c, p in zip("abc", (110, 120, 130), strict=True))
    assert [(i.name, i.description, i.confidence) for i in menu.block_items(menu.Page(page(body)).annotated)] == [(f"Rett {c}", "En lang og god beskrivelse", 0.9) for c in "abc"]
    two = "".join(f"<h3>拉麵{c}</h3><h3>Ramen {c}</h3><p>{p} kr</p>" for c, p in zip("abc", (110, 120, 130), strict=True))
    assert [i.name for i in menu.block_items(menu.Page(page(two)).annotated)][0] == "拉麵a Ramen a"


def test_trailing_cards_and_numbering():
    body = "".join(f"<h3>{n}. Rett nr {n}</h3><p>beskrivelse her</p><p>{100 + n},-</p>" for n in range(1, 10))
    items = menu.trailing_items(menu.Page(page(body)))
    assert [(i.name, i.price_minor) for i in items] == [(f"Rett nr {n}", 10000 + 100 * n) for n in range(1, 10)]
    assert [i.name for i in menu.extract(page(body))] == [f"Rett nr {n}" for n in range(1, 10)]
    scoped = page("<p>Lunsj</p><p>Suppe</p><p>99,-</p><p>A la carte</p>" + "".join(f"<p>Rett {c}</p><p>{p},-</p>" for c, p in zip("abcd", (110, 120, 130, 140), strict=True)) + "<p>Drikke</p><p>Brus</p><p>45,-</p>")
    assert [(i.name, i.section, i.confidence) for i in menu.trailing_items(menu.Page(scoped))] == [(f"Rett {c}", "A LA CARTA", 0.99) for c in "abcd"]


def test_heading_over_two_lines():
    assert visible_lines(page("<h2>Two<br>lines</h2>")) == ["Two lines"]


def test_printed_scopes():
    items = printed.scoped_items(["MAT", "Pho 189", "LUNSJMENY", "Biff bolle 150", "MIDDAGSMENY", "Biff bolle 250", "COCKTAILS", "Dry Martini 145", "DESSERT", "Is 85", "Vårrull", "25 pr stk"])
    assert [(i.name, i.price_minor) for i in items] == [("Pho", 18900), ("Biff bolle", 15000), ("Biff bolle", 25000), ("Is", 8500), ("Vårrull", 2500)]


def test_descriptions_taken_for_names_get_their_titles():
    body = "".join(f"<h3>Rett {c}</h3><p>Fersk {c} med avokado og lime {p},-</p>" for c, p in zip("abc", (150, 160, 170), strict=True))
    items = menu.general_reading(menu.Page(page(body)))
    assert [(i.name, i.description, i.confidence) for i in items] == [(f"Rett {c}", f"Fersk {c} med avokado og lime", 0.78) for c in "abc"]
    alone = menu.general_reading(menu.Page(page("<h3>Rett a</h3><p>Fersk laks med avokado og lime 150,-</p><p>Suppe 99,-</p><p>Brød 45,-</p>")))
    assert "Rett a" not in [i.name for i in alone]
