"""Made lines with labelled persons and places, for fitting and for judging the tagger of names.

A line is a sentence with slots. Names and places come from short lists and, mostly, from syllables, so that the tagger has
to go by what stands around them and by their form. The lines to judge by have sentences, names and places of their own.
"""

from __future__ import annotations

import random

from quillmill.functions.tagging import TOKEN

GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty "
    "Mark Sandra Paul Ashley Steven Emily Andrew Donna Kenneth Carol George Ruth Carlos Maria Ahmed Fatima Wei Priya Ivan Olga Jean Claire Hans Greta Jane Ada Peter Laura"
).split()
GIVEN_OUT = "Zoltan Edit Rajesh Ananya Kwame Amina Sven Ingrid Pablo Lucia Yuki Haruto Marek Zofia Omar Layla Brian Helen Gregory Judith Stephen Alice".split()
SURNAMES = "Smith Johnson Brown Jones Garcia Miller Davis Wilson Anderson Taylor Moore Martin Lee Walker Hall Allen Young King Wright Scott Nguyen Hill Green Baker Roe Doe Byron Weber Rossi Novak Khan Singh".split()
SURNAMES_OUT = "Kiss Raman Abbott Carter Mitchell Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Reed Okafor Lindqvist Haddad Kowalski Tanaka".split()
PLACES = "Chicago Springfield Boston Dallas Denver Seattle Atlanta Houston Illinois Ohio Texas California France Germany London Paris Berlin Madrid Peoria Evanston".split()
PLACES_OUT = "Toledo Naperville Oregon Nevada Vienna Oslo Lisbon Tucson Portland Kansas Mexico Canada".split()
#: Capitalised words that name nobody.
OTHER = (
    "Court of Appeals|Supreme Court|Motion to Dismiss|Exhibit A|Illinois Bar Journal|Circuit|Monday|Tuesday|March|October|English|Plaintiff|Defendant|Page|Opinion|Law Division|Attorneys for Plaintiff|Case|Section|"
    "Passport|Social Security|Medical Center|Bar Association|Federal Rules|Summary Judgment|Department|Board|Act|Internet|Seventh Circuit|Ninth Circuit|Call|Source|Westlaw|Subject|Re|Chapter|Table|Amendment|General Hospital|Quarterly Report"
).split("|")
OTHER_OUT = "Appellate Division|Notice of Appeal|Friday|June|Spanish|Respondent|Appendix|Ruling|Statute|Tax Code|City Council|Annual Review|Volume|Figure|Insurance Company".split("|")
WORDS = "the of a and to that was by with for on his her their from not it is were had this which no any case record evidence claim contract payment hearing letter report judge witness counsel party order date".split()
SYLLABLES = "ba ken dor mi ral ston wick ham ley ver to na rin gal po sha ren ek mor ti lan dra bus fel hol cas win der al bert ma ri no ka zu".split()
#: {P} a person, {S} one by the surname alone, {G} by the given name alone, {L} a place, {O} capitalised words, {w} words, {W} words behind a capital.
SENTENCES = (
    "{P} {w}.", "{W} {P} {w}.", "{W} {w} by {P} and {P}.", "Dear {P},", "Dear {G},", "From: {P}", "To: {P}", "Cc: {P}; {P}", "Attorney: {P}", "Signed, {P}", "Sincerely, {P}", "I spoke with {P} about {w}.",
    "{P} testified that {w}.", "{P} lives in {L}.", "{P} of {L} {w}.", "On {O}, {P} met {P} in {L}.", "The witness, {P}, {w}.", "{W} {w} in {L}.", "{W} {w} near {L} {w}.", "He moved to {L} from {L}.", "Mr. {S} {w}.",
    "{W} Mrs. {S} and Dr. {P} {w}.", "{O} {w}.", "{W} the {O} {w}.", "{O} and {O} {w}.", "{W} {w}, {w}.", "{W} {w} {w}.", "{w} {O} {w}", "{P} v. {P}", "{S} v. {S}, {O}", "patient {P} was seen on {O}.", "plaintiff {P} and her son {G} {w}.",
    "my sister {G} {w}.", "her brother {P} {w} in {L}.", "Name: {P}", "{P}, a resident of {L}, {w}.", "born in {L} to {P} and {P}.", "{W} {w} said {P}.", "told {P} that {w}.", "Department: {O}", "{O}: {w}", "SSN 123-45-6789, filed {O} 15, 2024.",
    "{W}. {W} {w}. ", "{W} {w}?", "Call {P} at the {O}.", "{P} ({L}) {w}.", "{U} {w}", "{W} {w} {O}, {O} {w}.", "{W} {w} {P}'s {w}.", "{w} {w} {w}.", "- {w} {W}", "{W} {W} {w}", "{W} {W} {W} {w}.",
    "| {W} | {w} | {W} |", "{w} | {W} {w}", "* {W} & {W} {w}", "{W}! {W} {w}!", "{w}. {W}, {w}, {W} {w}.", "{W} {w} {W} {w} {W} {w}.", "{W} {U} {w} $ {W}", "Page header {w}", "{O} of {O}",
)
SENTENCES_OUT = (
    "{P} wrote to {P} about {w}.", "According to {P}, {w}.", "{W} {w}, and {P} {w}.", "Yesterday {P} returned to {L}.", "{W} {w} for {P}.", "The {O} denied it.", "{W} {w} of the {O}.", "The nurse called {P} in {L}.",
    "Witness: {P}", "Regards, {P}", "{P} agreed.", "{W} {w} was in {L}.", "Ms. {S} and {P} left {L}.", "{O} {w} {w}.", "{W} {w} {w}.", "Please contact {P} or {P}.", "{W} {W} {w}.", "her daughter {G} {w}.", "{P}, who {w}, {w}.",
)


def _made(rnd: random.Random, parts: tuple[int, int] = (2, 3)) -> str:
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(*parts)))


def _word(rnd: random.Random) -> str:
    return rnd.choice(WORDS) if rnd.random() < 0.5 else _made(rnd, (1, 3))


def _pick(rnd: random.Random, listed: list[str]) -> str:
    return rnd.choice(listed) if rnd.random() < 0.5 else _made(rnd).capitalize()


def _slot(rnd: random.Random, kind: str, held_out: bool) -> tuple[str, str]:
    given, surnames, places, other = (GIVEN_OUT, SURNAMES_OUT, PLACES_OUT, OTHER_OUT) if held_out else (GIVEN, SURNAMES, PLACES, OTHER)
    if kind == "P":
        first = rnd.choice(given) if rnd.random() < 0.7 else _made(rnd).capitalize()
        last = _pick(rnd, surnames)
        form = rnd.random()
        name = f"{first} {last}" if form < 0.7 else f"{first} {rnd.choice('ABCDEFGHJKLMRSTW')}. {last}" if form < 0.85 else f"{first[0]}. {last}" if form < 0.93 else f"{first} {last}".upper()
        return name, "PERSON"
    if kind == "S":
        return _pick(rnd, surnames), "PERSON"
    if kind == "G":
        return rnd.choice(given), "PERSON"
    if kind == "L":
        form = rnd.random()
        town = _pick(rnd, places)
        if form > 0.93:
            return f"{rnd.randint(1, 9999)} {_pick(rnd, surnames)} {rnd.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'])}", "LOCATION"
        return (town if form < 0.65 else f"{rnd.choice(['New', 'San', 'North', 'Fort', 'Lake'])} {town}" if form < 0.85 else f"{town}, {rnd.choice(places)}"), "LOCATION"
    if kind == "O":
        return rnd.choice(other), ""
    if kind == "U":
        return " ".join(_word(rnd).upper() for _ in range(rnd.randint(1, 4))), ""
    words = [_word(rnd) for _ in range(rnd.randint(1, 5))]
    return (" ".join([words[0].capitalize(), *words[1:]]) if kind == "W" else " ".join(words)), ""


def line(rnd: random.Random, held_out: bool = False) -> tuple[list[str], list[str]]:
    """The words of one line and their tags."""
    words, tags = [], []
    pieces = rnd.choice(SENTENCES_OUT if held_out else SENTENCES).replace("{", "\0{").replace("}", "}\0").split("\0")
    for piece in pieces:
        text, kind = _slot(rnd, piece[1], held_out) if piece.startswith("{") else (piece, "")
        mine = TOKEN.findall(text)
        words += mine
        tags += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(mine))]
    return words, tags
