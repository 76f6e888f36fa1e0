"""Thresholds and word lists. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def one_of(words: list[str] | tuple[str, ...], bounded: bool = False) -> str:
    """A Java pattern for any of the words, ignoring case beyond ASCII."""
    body = "|".join(re.escape(w) for w in words)
    return rf"(?iuU)\b(?:{body})\b" if bounded else f"(?iu)(?:{body})"


# Word lists, patterns and thresholds that results depend on.

FILLER_WORDS = ["ну", "вот", "как бы", "типа", "короче", "собственно", "так сказать", "это самое", "в общем-то", "как говорится", "блин", "чё", "чо"]
INTERJECTIONS = ["э", "ээ", "эээ", "эм", "эмм", "ммм", "мм", "аа", "ааа", "ну-ну", "э-э", "э-э-э", "а-а", "а-а-а"]
AD_MARKERS = [
    "промокод", "erid", "рекламодател", "спонсор", "при поддержке", "партнёр выпуска", "партнер выпуска", "наш партнёр", "наш партнер",
    "ссылка в описании", "ссылочк", "ссылки в описании", "по ссылке ниже", "переходите по ссылке", "скидка по ссылке", "скидку по промокоду",
    "кэшбэк", "кешбэк", "промо-код", "закреплённом комментарии", "закрепленном комментарии", "устанавливайте приложение", "качайте приложение",
    "скачивайте приложение",
]
DELIVERY_MARKERS = ["обзор доставки", "доставка еды", "заказал доставку", "заказали доставку", "проверка доставки", "доставка из", "доставки на дом"]
INGREDIENT_UNITS = (
    r"\d+(?:[.,]\d+)?\s*"
    r"(?:г|гр|грамм\w*|кг|мл|л|литр\w*|ст\.?\s?л\.?|стол\w*\s+ложк\w*|"
    r"ч\.?\s?л\.?|чайн\w*\s+ложк\w*|шт\.?|штук\w*|зубчик\w*|стакан\w*|"
    r"щепот\w*|горст\w*|долек|долько\w*|ломт\w*|пучок|пучк\w*|банк\w*|уп\.?|пачк\w*)"
)
INGREDIENT_PHRASES = ["по вкусу", "на кончике ножа", "щепотка", "по желанию"]
STEP_VERBS = [
    "нареж", "режем", "режьте", "обжар", "жар", "туш", "варим", "варить", "отвар", "запек", "запеч", "смешай", "смешива", "перемеш", "добав",
    "посол", "поперч", "посыпь", "натри", "натёр", "натер", "выклад", "выложи", "полей", "залей", "взбей", "взбива", "маринуй", "марин",
    "разогрей", "разогрева", "поставь", "ставим", "накрой", "остуд", "нагрей", "нагрева",
]
SEQUENCE_MARKERS = [
    "сначала", "затем", "потом", "далее", "после этого", "после чего", "теперь", "следующим шагом", "в конце", "в самом конце", "параллельно",
    "тем временем", "как только", "когда", "первым делом",
]
INTRO_MARKERS = [
    "всем привет", "здравствуйте", "дорогие друзья", "друзья", "сегодня приготов", "сегодня будем готов", "сегодня я приготов", "в этом видео",
    "в этом ролике", "меня зовут", "с вами", "сегодня у нас",
]
OUTRO_MARKERS = [
    "приятного аппетита", "ставьте лайк", "ставьте лайки", "подписывайтесь", "подпишись", "до новых встреч", "до новых видео", "всем пока",
    "до встречи", "приятного просмотра", "спасибо за просмотр", "пишите в комментар",
]
#: Patterns of a line's cleaning and what they become: before fillers go, and after. Fixed values.
LINE_MARKS = [
    (r"[\[(][^\])]*[\])]", " "),
    (r"(?U)^\s*(>>|-)\s+", ""),
]
LINE_SPACING = [
    (r"(?iuU)\b(\w+)(\s+\1\b)+", "$1"),
    (r"(?U)\s+([,.!?…:;])", "$1"),
    (r"(?U)\s+", " "),
    (r"^ | $", ""),
    (r"(?U)^[,.;:!?…\-\s]+", ""),
]
PLAYLIST_INTENTS = [
    (r"сала[тд]", "Салаты"),
    (r"\bсуп\w*|борщ|\bщи\b|солянк", "Супы"),
    (r"ры[бо]\w*|лосос|форел|треск|креветк|кальмар|\bмиди\w*|морепродукт", "Блюда из рыбы и морепродуктов"),
    (r"закуск|намазк|паштет|брускетт", "Закуски"),
    (r"\bкури\w*|\bкуроч\w*|\bкур\b|индейк|\bутк\w*|птиц", "Блюдо из птицы"),
    (r"стейк|говядин|свинин|баранин|мяс\w*|фарш|котлет", "Блюда из мяса"),
    (r"шашлык|мангал|\bгрил\w*|барбекю|бербекю|на угл\w*|на костре", "Мангал, гриль, бербекю, печь"),
    (r"бутер\w*|сэндвич|сендвич|тост\w*", "Бутеры"),
    (r"новогодн|на новый год|рождествен", "Новогодние рецепты"),
]
SECTION_WEIGHTS = {"intro": 0.35, "outro": 0.25, "ingredients": 1.15}
PUNCTUATION_SUFFIXES = {
    "O": "", "PERIOD": ".", "COMMA": ",", "QUESTION": "?", "TIRE": " —", "DVOETOCHIE": ":", "VOSKL": "!", "PERIODCOMMA": ";", "DEFIS": "-",
    "MNOGOTOCHIE": "...", "QUESTIONVOSKL": "?!",
}

# End of fixed word lists.


@dataclass(frozen=True)
class Lexicon:
    """Word lists of one language."""

    fillers: tuple[str, ...]
    interjections: tuple[str, ...]
    ad_markers: tuple[str, ...]
    skip_markers: tuple[str, ...]
    units: str
    ingredient_phrases: tuple[str, ...]
    step_verbs: tuple[str, ...]
    sequence_markers: tuple[str, ...]
    intro_markers: tuple[str, ...]
    outro_markers: tuple[str, ...]
    intents: tuple[tuple[str, str], ...] = ()


RUSSIAN = Lexicon(
    tuple(FILLER_WORDS), tuple(INTERJECTIONS), tuple(AD_MARKERS), tuple(DELIVERY_MARKERS), INGREDIENT_UNITS, tuple(INGREDIENT_PHRASES),
    tuple(STEP_VERBS), tuple(SEQUENCE_MARKERS), tuple(INTRO_MARKERS), tuple(OUTRO_MARKERS), tuple(PLAYLIST_INTENTS),
)


@dataclass(frozen=True)
class CleanConfig:
    ad_before: float = 8.0
    ad_after: float = 25.0
    block_target: int = 400
    block_max: int = 750
    gap_seconds: float = 3.0
    lexicon: Lexicon = RUSSIAN


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 450
    max: int = 600
    min: int = 120
    overlap: int = 80
    chars_per_token: float = 2.5
    lexicon: Lexicon = RUSSIAN


@dataclass(frozen=True)
class RetrievalConfig:
    top_videos: int = 2
    per_video: int = 6
    overfetch: int = 6
    search_overfetch: int = 5
    rerank_top: int = 24
    token_budget: int = 5200
    passage_words: int = 500
    overlap_words: int = 120
    block_cost: int = 24
    neighbor_radius: int = 1
    section_weights: dict[str, float] = field(default_factory=lambda: dict(SECTION_WEIGHTS))
    first_weight: float = 0.30
    last_weight: float = 0.35
    min_score: float = 0.005
    rrf_constant: int = 60
    chars_per_token: float = 2.5
    mode: str = "hybrid"

    @property
    def pool(self) -> int:
        """How many candidates the search gives."""
        return max(self.top_videos * self.per_video * self.overfetch, self.rerank_top)
