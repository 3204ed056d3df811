"""Language profiles: token pattern, stopwords, suffixes, synonyms."""

from __future__ import annotations

from dataclasses import dataclass, field

# Russian stopwords.
RUSSIAN_STOPWORDS = """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по
только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть
был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может они тут где есть надо
ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь будет ж тогда кто
этот говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас
были куда зачем сказать всех никогда сегодня можно при наконец два об другой хоть после над больше тот
через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше
чуть том нельзя такой им более всегда конечно всю между это который которые которых также очень своих
таких является"""

# Russian suffixes, of which a token loses the longest that leaves three characters.
RUSSIAN_SUFFIXES = """ования ование ениями ение ениям ениях ироваться ирован ировать ами ями ого его ому ему
ыми ими ая ое ые ий ый ой ей ом ем ах ях ую юю ее ии ия ие ов ев ь а я о е у ю ы и й"""

# Synonyms of building-code terms, in the order in which they are tried.
SYNONYMS = {
    "коридор": ["проход", "проходной коридор", "эвакуационный путь", "путь эвакуации", "холл"],
    "лестница": ["лестничная клетка", "марш", "эвакуационная лестница", "ступени"],
    "ширина": ["минимальная ширина", "размер", "габарит"],
    "высота": ["высота помещения", "высота этажа", "минимальная высота", "высота подоконника", "высота окна"],
    "подоконник": ["оконный проём", "высота подоконника", "окно", "подоконная доска"],
    "окно": ["оконный проём", "остекление", "подоконник"],
    "мжк": ["жилой комплекс", "многоквартирный дом", "жилое здание", "многоквартирный жилой комплекс"],
    "многоквартирный": ["многоквартирный дом", "жилой комплекс", "МЖК"],
    "жилой": ["жилой комплекс", "многоквартирный дом", "жилое здание"],
    "здание": ["строение", "сооружение", "объект"],
    "общественное здание": ["административное здание", "общественное сооружение"],
    "эвакуационный": ["эвакуация", "пожарный", "аварийный выход"],
}


@dataclass(frozen=True)
class Profile:
    """How a language is tokenised; `stem` strips one suffix and keeps three characters."""

    token: str
    stopwords: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    @property
    def stem(self) -> str:
        longest = sorted(self.suffixes, key=len, reverse=True)
        return "^(.{3,}?)(?:" + "|".join(longest) + ")$"


RUSSIAN = Profile("[а-яa-z0-9]+", tuple(RUSSIAN_STOPWORDS.split()), tuple(RUSSIAN_SUFFIXES.split()), SYNONYMS)
LATIN = Profile(
    "[a-zà-ÿ0-9]+",
    tuple("the and of to in a is that la de que le les et en der die und das el los".split()),
    tuple("ing tion ed ly es en ung heit ment".split()),
    {"the": ["this", "that these"], "tion": ["sion", "ment"], "ing": ["ung"]},
)
