"""Word lists of a language, as one parameter of what reads texts by words."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Words:
    """Lists of one language or of several together. A word that doesn't begin with an ASCII letter, or a phrase, matches as a substring;
    other words match whole white-space tokens. Cities and countries match as they are written, as whole words."""

    events: tuple[str, ...]
    activities: tuple[str, ...]
    emotions: tuple[str, ...]
    preferences: tuple[str, ...]
    relationships: tuple[str, ...]
    possessives: tuple[str, ...]
    prepositions: tuple[str, ...]
    units: tuple[str, ...]
    days: tuple[tuple[str, ...], ...]
    every: tuple[str, ...]
    day_adverbs: tuple[tuple[str, ...], ...] = ((),) * 7
    cities: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()


# English words, social prepositions of several languages, and German weekday adverbs, Sunday first.
ENGLISH = Words(
    events=(
        "wedding", "funeral", "concert", "conference", "meeting", "interview", "party", "birthday", "anniversary", "graduation", "ceremony", "reception", "reunion", "trip", "vacation", "holiday", "flight",
        "check-in", "checkout", "appointment", "surgery", "exam", "audition", "performance", "presentation", "demo", "launch", "deployment", "sprint", "standup", "retrospective", "hackathon", "barbecue", "bbq",
        "picnic", "marathon", "race", "tournament", "match", "game",
    ),
    activities=(
        "cooking", "cooked", "hiking", "hiked", "running", "ran", "swimming", "swam", "yoga", "meditation", "cycling", "cycled", "fishing", "fished", "gardening", "painting", "painted", "reading", "writing", "wrote",
        "dancing", "danced", "singing", "sang", "traveling", "travelled", "camping", "camped", "climbing", "climbed", "skiing", "surfing", "jogging", "jogged", "walking", "walked", "volunteering", "volunteered",
        "studying", "studied", "practicing", "practiced", "debugging", "debugged", "coding", "coded", "refactoring", "refactored", "deploying", "deployed", "testing", "tested",
    ),
    emotions=(
        "excited", "thrilled", "ecstatic", "elated", "overjoyed", "happy", "pleased", "satisfied", "content", "grateful", "relieved", "calm", "peaceful", "frustrated", "angry", "furious", "anxious", "panicked",
        "overwhelmed", "stressed", "sad", "disappointed", "bored", "tired", "exhausted", "worried", "nervous", "confused", "annoyed", "upset", "surprised", "curious", "nostalgic", "ambivalent",
    ),
    preferences=(
        "prefer", "preferred", "preference", "favorite", "favourite", "like", "liked", "love", "loved", "enjoy", "enjoyed", "always get", "go-to", "rather", "better than", "best", "hate", "hated", "dislike",
        "disliked", "avoid", "can't stand", "recommend", "recommended", "suggestion", "usually", "typically", "tend to",
    ),
    relationships=(
        "mother", "father", "sister", "brother", "wife", "husband", "partner", "daughter", "son", "aunt", "uncle", "cousin", "grandmother", "grandfather", "grandma", "grandpa", "niece", "nephew", "friend",
        "girlfriend", "boyfriend", "fiancée", "fiancé", "boss", "manager", "colleague", "coworker", "teammate", "mentor", "teacher", "professor", "doctor", "therapist", "lawyer", "accountant", "neighbour",
        "neighbor", "roommate", "flatmate", "landlord", "client", "customer", "contractor", "vet", "dentist", "babysitter", "nanny", "coach", "trainer", "instructor",
    ),
    possessives=("my", "his", "her", "their", "our"),
    prepositions=("with", "mit", "avec", "con", "com", "for", "für", "pour", "para"),
    units=(
        "tanks", "tank", "books", "book", "dollars", "dollar", "euros", "euro", "pounds", "pound", "kilograms", "kg", "kilometers", "km", "miles", "mile", "liters", "liter", "litres", "litre", "cups", "cup",
        "glasses", "glass", "bottles", "bottle", "pieces", "piece", "items", "item", "tickets", "ticket", "sessions", "session", "episodes", "episode", "chapters", "chapter", "pages", "page", "movies", "movie",
        "films", "film", "songs", "song", "albums", "album", "photos", "photo", "pictures", "picture", "meals", "meal", "classes", "class", "lessons", "lesson", "rounds", "round", "sets", "set", "reps", "rep",
        "laps", "lap",
    ),
    days=(("sunday",), ("monday",), ("tuesday",), ("wednesday",), ("thursday",), ("friday",), ("saturday",)),
    every=("every", "each", "weekly"),
    day_adverbs=(("sonntags",), ("montags",), ("dienstags",), ("mittwochs",), ("donnerstags",), ("freitags",), ("samstags",)),
)
