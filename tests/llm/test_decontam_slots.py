import time

import numpy as np
import pytest

from tidemill.llm import decontam

ITEMS = {
    "sequence": "Continue the sequence: 1 1 2 3 5 8 13 21 34 55 89 144 233 377",
    "arithmetic": "What is 3 + 4 * 5 - 6 / 2 + 1 - 7 + 4 * 3 - 5 + 6 + 2",
    "names": "the winners were Anna Bob Carla Dan Anna Eve Frank Bob Gus Hal and then it ended for all of them",
    "capitals": "THE QUICK BROWN FOX AND THE LAZY DOG AND THE CAT RAN AWAY FROM THE FARM",
    "periodic": "Tom has 3 apples, Sue has 5 apples, Tom has 7 apples, Ann has 3 apples, Sue has 9 apples, how many apples are there in all",
}


def find(item, text):
    raw = text.encode()
    return decontam.Index([(1, item)]).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


@pytest.mark.parametrize("name", ITEMS)
def test_verbatim_copies(name):
    """Copies whose template repeats within a window, alone and among text of the same shape."""
    item = ITEMS[name]
    (alone,) = find(item, item)
    assert alone[2] == 0 and alone[3] == decontam.Index([(1, item)]).need[0] and alone[4] == 1
    for before, after in (("Some text first. ", " and more text after it."), ("7 7 8 8 9 9 1 2 " * 20, " 7 7 8 8 9 9" * 20), ("Tom has 3 apples, Tom has 3 apples, " * 5, " More.")):
        assert len(find(item, before + item + after)) == 1


def test_other_words_and_insertions():
    other = ITEMS["periodic"].replace("Tom", "Max").replace("3", "30")
    assert find(ITEMS["periodic"], other)
    assert not find(ITEMS["periodic"], ITEMS["periodic"].replace("Sue", "Tom").replace("9", "3").replace("5", "3").replace("7", "3"))
    long = "the boat left Dover at 7 with 12 sacks of salt and reached Calais at 9 where Anna paid 40 coins for all of the salt and Bob took 12 coins home"
    assert find(long, long.replace("sacks of", "sacks of very")) and find(long, long.replace("Dover", "Hull").replace("12", "15"))


def test_shape_alone_is_no_copy():
    assert not find(ITEMS["sequence"], "Continue the sequence: 9 4 6 7 1 3 15 20 30 50 80 140 230 370")
    assert not find(ITEMS["sequence"], "9 4 6 7 1 " * 30) and not find(ITEMS["sequence"], "1 2 3 4 5")
    assert not find("1 2 3 4 5 6 7 8", "11 12 13 14 15 16 17 18 19") and find("1 2 3 4 5 6 7 8", "0 0 0 1 2 3 4 5 6 7 8 0 0")


GERMAN = "Der Zug fährt um 9 Uhr von Berlin nach Köln und hält in Hannover und in Dortmund; wie lange dauert die Übung der Reise?"


@pytest.mark.parametrize("text", [GERMAN.upper(), GERMAN.lower(), GERMAN.upper().replace("9", "11")])
def test_case_hides_no_copy(text):
    """Copies in capitals or small letters, alone and inside ordinary text, other numbers too; not with other names."""
    assert find(GERMAN, text) and find(GERMAN, f"Ein Text steht davor. {text} Und einer danach.")
    other = text
    for name in ("berlin", "köln", "hannover", "dortmund"):
        other = other.replace(name, "ulm").replace(name.upper(), "ULM")
    assert not find(GERMAN, other)


def test_item_in_capitals():
    assert find(GERMAN.upper(), GERMAN) and find(GERMAN.upper(), GERMAN.upper()) and not find(GERMAN.upper(), "ANDERE WORTE STEHEN HIER IN GROSSEN LETTERN " * 9)


def test_placeholders_alone_cost_nothing():
    """Many capitalised words against many items of names: 43 seconds when every such window was a hit."""
    rng = np.random.default_rng(3)
    name = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6)).capitalize()
    items = [(i, " ".join(name() for _ in range(12))) for i in range(50)] + [(99, "the winners were " + " ".join(name() for _ in range(9)) + " and then it ended for all of them")]
    index = decontam.Index(items)
    raw = (" ".join(name() for _ in range(20_000)) + " " + items[7][1] + " " + items[-1][1]).encode()
    began = time.time()
    found = index.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [f[1] for f in found] == [7, 99] and time.time() - began < 5
