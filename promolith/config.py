"""Thresholds and dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

# Gap thresholds in hours, and the factor on the poll interval.
MIN_GAP_HOURS = 3.0
GAP_FACTOR = 8
MAX_GAP_HOURS = 12.0
MIN_WEIGHT_HOURS = 1e-6
TRUSTED_MATCH = ("confirmed", "auto_matched")
MATCH_STATUSES = ("confirmed", "auto_matched", "provisional", "review")

# Names of the weekdays, Monday first.
WEEKDAYS = ("Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс")

# What a shop sells, where the name tells nothing.
SHOP_CATEGORY = {
    "lenta": "продукты",
    "magnit": "продукты",
    "podruzhka": "косметика",
    "iledebeaute": "косметика",
    "mvideo": "электроника",
    "holodilnik": "электроника",
}
NO_GROUP, NO_CATEGORY = "не распознано", "прочее"

# Group, category and keywords; the first group that has a
# keyword inside the lower-cased name wins.
GROUPS = (
    ("молочные продукты", "продукты", ("молоко", "кефир", "творог", "йогурт", "сливки", "сметана", "ряженк")),
    ("сыры", "продукты", ("сыр ", "сыры", "сыр,")),
    ("мороженое", "продукты", ("мороженое", "эскимо", "пломбир")),
    ("снеки и сухие завтраки", "продукты", ("чипсы", "гранола", "снеки", "попкорн", "сухие завтраки", "мука")),
    ("кондитерские изделия", "продукты", ("мармелад", "шоколад", "конфет", "ирис", "пастила", "вафл", "печенье", "яйцо шоколадн")),
    ("готовая кулинария и консервы", "продукты", ("салат ", "паштет", "филе ", "ресто шик", "горбуша", "колбас", "пельмен", "шпрот", "тунец")),
    ("уход за телом", "косметика", ("скраб для тела", "гель для душа", "мыло", "крем для тела", "лосьон для тела", "фитобальзам", "молочко для тела")),
    ("уход за волосами", "косметика", ("шампунь", "бальзам для волос", "маска для волос", "кондиционер для волос", "крем-спрей для волос")),
    ("уход за лицом", "косметика", ("крем для лица", "сыворотка", "тонер", "маска для лица", "пенка для умывания", "мицеллярная вода", "ампула", "патчи", "пэды", "тканевая")),
    ("декоративная косметика", "косметика", ("тушь", "mascara", "палетка теней", "помада", "пудра", "блеск", "подводка", "бровей", "румяна", "набор для макияжа", "тени", "палетка для лица")),
    ("парфюмерия", "косметика", ("парфюмерная вода", "туалетная вода", "дезодорант", "аромат", "духи")),
    ("гигиена", "косметика", ("зубная щетка", "зубная паста", "ополаскиватель")),
    ("подарочные наборы", "косметика", ("подарочный набор", "новогодний набор", "набор ")),
    ("бытовая техника", "электроника", ("холодильник", "стиральная машина", "сушильная машина", "посудомоечн", "варочная панель", "духов", "морозильн")),
    ("электроника", "электроника", ("телевизор", "смартфон", "ноутбук", "наушник", "колонка", "планшет", "фотоаппарат", "видеокамера", "допплер", "преобразователь сигнала")),
    ("авто и мото", "прочее", ("шина", "мотор ", "бензобур", "аккумулятор", "масло моторн", "автодокумент")),
    ("товары для детей", "прочее", ("погремушка", "ходунки", "пеленан", "пеленал", "кроватк")),
    ("спорт и отдых", "прочее", ("фитбол", "гимнастическ", "гантел", "дайвинг")),
    ("инструменты", "прочее", ("переходник", "отрезная", "шнек", "дрель")),
    ("хозтовары", "прочее", ("стакан для ванной", "мыльница", "фартук", "противень", "банный", "килт")),
)


@dataclass(frozen=True)
class FakePromoConfig:
    """Thresholds (percent or points) and weights of the rules.  The defaults are fixed values."""

    old_price_jump_pct: float = 5.0
    promo_flat_pct: float = 1.0
    promo_rise_pct: float = 2.0
    both_rise_pct: float = 5.0
    both_rise_discount_tol: float = 1.5
    depth_swing_pp: float = 10.0
    worse_than_best_pct: float = 3.0
    outlier_quantile: float = 0.95
    w_old_jump: float = 1.0
    w_promo_rise: float = 0.8
    w_both_rise: float = 1.0
    w_depth_swing: float = 0.5
    w_worse_than_best: float = 0.6
    suspicious: float = 0.30
    likely_fake: float = 0.60

    @property
    def total_weight(self) -> float:
        return self.w_old_jump + self.w_promo_rise + self.w_both_rise + self.w_depth_swing + self.w_worse_than_best
