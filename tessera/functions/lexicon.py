"""Word lists and patterns that the text operators are given; every list is data and can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    core: tuple[str, ...]
    #: A pair matches when both of its patterns do.
    pairs: tuple[tuple[str, str], ...]
    #: Broader than ``core`` and ``pairs``: worth a closer look.
    candidate: tuple[str, ...]
    dispute: tuple[str, ...]
    dispute_titles: tuple[str, ...]
    risk_titles: tuple[str, ...]
    normative: tuple[str, ...]
    formal: str
    frontier: tuple[str, ...]
    industry: tuple[str, ...]
    regional: tuple[str, ...]
    regional_scope: str
    national: tuple[str, ...]
    noise_title: str
    site_noise: str
    training_title: str
    training_url: str
    whitelist: tuple[str, ...]
    reject_reason: str
    contradictory_reason: str
    #: Topic areas in order: name and pattern.
    areas: tuple[tuple[str, str], ...]
    #: Event dimensions of a title in order: name and pattern.
    events: tuple[tuple[str, str], ...]


#: A small list of our own over invented prose, so that every branch is met on the sample tables.
SAMPLE = Lexicon(
    strong=("anther", "enheit", "tionoi", "ciónque"),
    weak=("there", "ement", "keit", "mente"),
    core=("theand", "eauoi", "achlich"),
    pairs=(("(?i)ingly", "(?i)ation"), ("heit", "lich")),
    candidate=("the", "eau", "lich", "ción"),
    dispute=("erand", "ouer", "inging", "zuch", "eauen"),
    dispute_titles=("Thent", "Oueau"),
    risk_titles=("Anth", "Heit"),
    normative=("Ing", "Ver", "Que"),
    formal="(on|er|en)([ .,]|$)",
    frontier=("Ion", "The", "Le"),
    industry=("And", "Die", "De"),
    regional=("Th", "El"),
    regional_scope="nd|os",
    national=("In", "La"),
    noise_title="(?i)^(home|about us|contact|more|login|subscribe)$",
    site_noise="(?i)%PDF|cookie policy|all rights reserved",
    training_title="(?i)training course|(^|[ ,])(ses|anan)([ .,]|$)",
    training_url="(?i)/(training|course)s?/",
    whitelist=("src3", "src7"),
    reject_reason="(?i)promotion|unrelated|low value",
    contradictory_reason="(?i)does not meet .{0,80}(criteria|standard)",
    areas=(("leasing", "ment"), ("supply_chain", "ation"), ("factoring", "the")),
    events=(("regulatory", "The|Die"), ("industry_model", "And|Le"), ("dispute", "On|El")),
)
