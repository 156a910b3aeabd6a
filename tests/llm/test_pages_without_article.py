"""Main text of pages that have no article element: short paragraphs, other languages, broken markup."""

import time

import pytest

from claimscope.llm.main_text import extract_main_text, main_text

NAV = "<nav><a href='/'>Home</a> <a href=/a>About</a></nav>"
FOOT = "<footer>&copy; 2020 Somebody</footer>"
LINE = "This is the first line of the text and it is long enough to be decided by its own words here."
ITALIAN = [
    "Nel mezzo del cammino il viaggiatore si ferma e guarda la valle che si apre davanti a lui, e non sa se tornare.",
    "La strada che porta al mare passa per il bosco e poi per i campi, dove la gente lavora fino a sera e canta.",
    "Quando il sole cala dietro i monti, la luce si fa rossa e le case del paese sembrano fatte di rame e di oro.",
    "Il vecchio che vive vicino al ponte dice che la neve arriva presto, e che il fiume non gela mai del tutto.",
    "Chi parte la mattina arriva a casa la sera, se la pioggia non ferma il carro e se il cavallo non si stanca.",
]
POLISH = [
    "Na początku drogi stoi stary dom, w którym od lat nikt nie mieszka, a mimo to ktoś pali w nim światło co noc.",
    "Ludzie ze wsi mówią, że to wiatr porusza okiennice, ale nikt z nich nie wszedł do środka, by to sprawdzić.",
    "Za domem jest las, a w lesie staw, do którego dzieci nie chodzą, bo woda w nim jest czarna i bardzo zimna.",
    "Kiedy przychodzi zima, staw zamarza, a na lodzie widać ślady, które nie należą do żadnego znanego zwierzęcia.",
    "Stary leśnik zna te ślady, ale nie chce o nich mówić, i na każde pytanie odpowiada, że to tylko lis lub sarna.",
]
CHINESE = ["这是一个很长的段落，讲述了一个关于山中老人的故事，他每天早晨都会走到河边看日出。", "后来他的孙子来到山里，和他一起种树，两个人在山上度过了整整十年的时间。", "那些树如今已经很高了，村里的人都说，这是他们见过的最美的树林。"]


def page(paragraphs, wrapper="div"):
    return f"<html><body>{NAV}<{wrapper}>{''.join(f'<p>{p}</p>' for p in paragraphs)}</{wrapper}>{FOOT}</body></html>"


@pytest.mark.parametrize("paragraphs", [
    ["Short page text.", "The end of it."],
    ["A poem", *[f"and line {i} goes by" for i in range(20)]],
    ITALIAN, POLISH, CHINESE,
    [CHINESE[0], "短句。", CHINESE[1]],
    [LINE, "A word on \xa9 signs, which stand in many a text, and are no reason at all to drop the paragraph that they are in.", LINE],
    [LINE, f"<a href=/x>{LINE}</a>", LINE],
])
def test_paragraphs_are_the_text(paragraphs):
    wanted = [p.removeprefix("<a href=/x>").removesuffix("</a>") for p in paragraphs]
    assert main_text(page(paragraphs)) == "\n".join(wanted)
    assert main_text(page(paragraphs, "section")) == "\n".join(wanted)


def test_what_is_no_text_stays_out():
    copyright_line = "\xa9 2020 by the owner of the site and all of the rights in it are reserved to the owner and to the others."
    assert main_text(f"<p>{LINE}</p><p>{LINE}</p><div>{copyright_line}</div><div><a href='/'>Top</a></div>") == f"{LINE}\n{LINE}"
    links = "".join(f"<div><a href=/{i}>{LINE}</a></div>" for i in range(3))
    assert main_text(f"<p>{LINE}</p>{links}") == LINE
    assert main_text(f"{NAV}{FOOT}") == "" and main_text(f"{NAV}<div><a href='/'>only a link</a></div>") == ""
    assert main_text(f"<article><p>Only short</p></article><div>Aside of it</div>") == "Only short"


@pytest.mark.parametrize("bad", ["<b>" * 125_000 + "</i>" * 125_000, "<b><i>" * 80_000 + "</u></i>" * 80_000, "<i>" + "<div><b>" * 60_000 + "</i>" * 100_000, "<h1>" * 200_000])
def test_a_megabyte_of_broken_markup_takes_linear_time(bad):
    def seconds(text):
        start = time.process_time()
        assert main_text(f"<article><p>{LINE}</p></article>{text}") == LINE
        return time.process_time() - start

    short, long = seconds(bad[: len(bad) // 8]), seconds(bad)
    assert long < 20 and long < 30 * max(short, 0.02)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "u", page(ITALIAN), 5), (1, "u", page(ITALIAN), 5), (2, None, None, 5), (None, "v", "", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "", 0), *[(1, "\n".join(ITALIAN), len("\n".join(ITALIAN)))] * 2, (2, "", 0)]
    assert extract_main_text(pages.limit(0)).collect() == []
