"""Language profiles: everything that depends on the language of a corpus, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    word: str  # a word in running text
    token: str  # a whole token that is kept by cleaning
    heading: str  # groups: number, title
    markers: dict[str, str] = field(default_factory=dict)
    stop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    skip_prefixes: tuple[str, ...] = ()
    references: tuple[str, ...] = ()


# They must equal those of the corpus conventions that results are compared with.
RUSSIAN = Profile(
    name="ru",
    word=r"[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*",
    token=r"[а-яё]+(?:-[а-яё]+)*",
    heading=r"(?iuU)^\s*Статья\s+(\d+(?:-\d+)?)\s*\.\s*(.*?)\s*$",
    markers={
        "обязан": r"\bобязан(?:а|о|ы)?\b",
        "должен": r"\bдолж(?:ен|на|но|ны)\b",
        "вправе": r"\bвправе\b",
        "не допускается": r"\bне\s+допускается\b",
        "запрещается": r"\bзапрещается\b",
        "подлежит": r"\bподлеж(?:ит|ат)\b",
    },
    keep=("не", "без", "нет", "нельзя", "данные", "должен", "должна", "должны", "должно", "должный", "обязан", "обязана", "обязаны", "вправе", "допускается", "запрещается", "подлежит"),
    stop=("и", "в", "во", "не", "на", "с", "со", "по", "к", "о", "об", "от", "до", "за", "из", "у", "или", "а", "но", "что", "как", "это", "для", "при", "без", "нет", "его", "её", "их", "он", "она", "они", "мы", "вы", "я", "быть", "был", "была", "были", "есть", "также", "так", "же", "бы", "ли", "то", "если", "этот", "тот", "который"),
    skip_prefixes=("Сноска.", "Примечание ИЗПИ!", "Примечание РЦПИ!", "Вниманию пользователей!", "Для удобства пользования"),
    references=("в соответствии с", "согласно", "предусмотренн", "настоящего кодекса"),
)

GENERIC = Profile(
    name="generic",
    word=r"\p{L}+(?:-\p{L}+)*",
    token=r"\p{L}+(?:-\p{L}+)*",
    heading=r"(?iuU)^\s*(?:Section|Article)\s+(\d+(?:-\d+)?)\s*\.\s*(.*?)\s*$",
    markers={"must": r"\b(?:must|shall)\b", "may not": r"\bmay\s+not\b", "required": r"\brequire[sd]?\b"},
    stop=("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "le", "la", "les", "de", "des", "et", "der", "die", "und", "el", "los", "que"),
    keep=("not", "without"),
)

PROFILES = {p.name: p for p in (RUSSIAN, GENERIC)}
