"""Yields, purchase costs by region, renovation and resale figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaria.functions.text import fold, strip

#: Defaults: down payment, rate, years; running costs and vacancy as shares of the rent; notary, registry and tax of unknown
#: regions in percent of the price, other costs in euros. (Fixed values.)
DOWN_PERCENT, RATE_PERCENT, YEARS = 20, 3, 25
RUNNING_PERCENT, VACANCY_PERCENT = 25, 8
NOTARY_PERCENT, REGISTRY_PERCENT, FIXED_COSTS, TAX_PERCENT = 0.3, 0.2, 300, 8
#: Renovation a square metre by depth, costs of resale in percent of the price, comparables that make a resale value sure,
#: and the highest plausible monthly community fee. (Fixed values.)
LIGHT, FULL, UNGRADED = 400, 900, 650
RESALE_PERCENT, SURE_SAMPLE, MOST_FEE = 10, 15, 2000
#: Transfer tax in percent by region. (Fixed values.)
REGION_TAX = {
    "Andalucía": 7, "Aragón": 8, "Asturias": 8, "Baleares": 8, "Canarias": 6.5, "Cantabria": 9, "Castilla y León": 8, "Castilla-La Mancha": 9, "Cataluña": 10, "Extremadura": 8,
    "Galicia": 8, "Madrid": 6, "Murcia": 8, "Navarra": 6, "País Vasco": 4, "La Rioja": 7, "Comunidad Valenciana": 9, "Ceuta": 3, "Melilla": 3,
}
#: Region of each province, without accents. (Fixed values.)
PROVINCE_REGION = {
    "almeria": "Andalucía",
    "cadiz": "Andalucía",
    "cordoba": "Andalucía",
    "granada": "Andalucía",
    "huelva": "Andalucía",
    "jaen": "Andalucía",
    "malaga": "Andalucía",
    "sevilla": "Andalucía",
    "huesca": "Aragón",
    "teruel": "Aragón",
    "zaragoza": "Aragón",
    "asturias": "Asturias",
    "principado de asturias": "Asturias",
    "baleares": "Baleares",
    "illes balears": "Baleares",
    "islas baleares": "Baleares",
    "mallorca": "Baleares",
    "las palmas": "Canarias",
    "santa cruz de tenerife": "Canarias",
    "tenerife": "Canarias",
    "cantabria": "Cantabria",
    "avila": "Castilla y León",
    "burgos": "Castilla y León",
    "leon": "Castilla y León",
    "palencia": "Castilla y León",
    "salamanca": "Castilla y León",
    "segovia": "Castilla y León",
    "soria": "Castilla y León",
    "valladolid": "Castilla y León",
    "zamora": "Castilla y León",
    "albacete": "Castilla-La Mancha",
    "ciudad real": "Castilla-La Mancha",
    "cuenca": "Castilla-La Mancha",
    "guadalajara": "Castilla-La Mancha",
    "toledo": "Castilla-La Mancha",
    "barcelona": "Cataluña",
    "girona": "Cataluña",
    "gerona": "Cataluña",
    "lleida": "Cataluña",
    "lerida": "Cataluña",
    "tarragona": "Cataluña",
    "badajoz": "Extremadura",
    "caceres": "Extremadura",
    "a coruna": "Galicia",
    "coruna": "Galicia",
    "la coruna": "Galicia",
    "lugo": "Galicia",
    "ourense": "Galicia",
    "orense": "Galicia",
    "pontevedra": "Galicia",
    "madrid": "Madrid",
    "murcia": "Murcia",
    "navarra": "Navarra",
    "alava": "País Vasco",
    "araba": "País Vasco",
    "gipuzkoa": "País Vasco",
    "guipuzcoa": "País Vasco",
    "bizkaia": "País Vasco",
    "vizcaya": "País Vasco",
    "araba/alava": "País Vasco",
    "la rioja": "La Rioja",
    "rioja": "La Rioja",
    "alicante": "Comunidad Valenciana",
    "alicante/alacant": "Comunidad Valenciana",
    "castellon": "Comunidad Valenciana",
    "castellon/castello": "Comunidad Valenciana",
    "valencia": "Comunidad Valenciana",
    "valencia/valencia": "Comunidad Valenciana",
    "ceuta": "Ceuta",
    "melilla": "Melilla",
}


def region(province: Column) -> Column:
    """The region of a province however it is accented; null for unknown ones."""
    pairs = [F.lit(x) for pair in PROVINCE_REGION.items() for x in pair]
    return F.create_map(*pairs)[strip(fold(province))]


def region_tax(province: Column) -> Column:
    rates = F.create_map(*(F.lit(x) for name, rate in REGION_TAX.items() for x in (name, float(rate))))
    return F.coalesce(rates[region(province)], F.lit(float(TAX_PERCENT)))


def annuity(loan: Column, rate_percent: float, years: int) -> Column:
    """Monthly payment; without interest the loan in equal parts."""
    n, r = years * 12, rate_percent / 100 / 12
    return loan / n if r == 0 else loan * F.lit(r) / (1 - F.pow(F.lit(1 + r), F.lit(-n)))


def purchase_costs(price: Column, tax_percent: Column) -> Column:
    return price * (tax_percent / 100) + price * (NOTARY_PERCENT / 100) + price * (REGISTRY_PERCENT / 100) + FIXED_COSTS


def works(m2: Column, condition: Column, severity: Column) -> Column:
    """Cost of renovation: nothing for renovated and new ones, null without a condition or (where there is work) a size."""
    rate = F.when(severity == "leve", LIGHT).when(severity == "integral", FULL).otherwise(UNGRADED)
    return F.when(condition.isin("reformado", "obra_nueva"), 0).when(condition.isNotNull() & (condition != "unclear") & (m2 > 0), rate * m2).cast("double")


def yields(price: Column, rent: Column, province: Column, tax: Column | None = None, community: Column | None = None, down: float = DOWN_PERCENT, rate: float = RATE_PERCENT, years: int = YEARS) -> dict[str, Column]:
    """gross, net and cash_on_cash in percent, and costs of purchase; null without a price or a rent. ``tax`` and
    ``community`` are a published yearly tax and monthly fee: where one is known (and the fee plausible), they and vacancy
    take the place of the assumed running costs. Net yield leaves purchase costs out, cash on cash counts them."""
    none = F.lit(None).cast("double")
    tax, community = none if tax is None else tax, none if community is None else F.when(community <= MOST_FEE, community)
    sound = (price > 0) & rent.isNotNull()
    year = rent * 12
    actual = F.coalesce(tax, F.lit(0.0)) + F.coalesce(community, F.lit(0.0)) * 12 + year * (VACANCY_PERCENT / 100)
    running = F.when(tax.isNotNull() | community.isNotNull(), actual).otherwise(year * (RUNNING_PERCENT / 100))
    net, costs = year - running, purchase_costs(price, region_tax(province))
    cash = price * (down / 100) + costs
    out = {"gross": year / price * 100, "net": net / price * 100, "cash_on_cash": (net - annuity(price * (1 - down / 100), rate, years) * 12) / cash * 100, "costs": costs}
    return {name: F.when(sound, F.try_divide(c, F.lit(1.0))) for name, c in out.items()}


def resale(median_m2: Column, m2: Column, sample: Column) -> tuple[Column, Column]:
    """Value after renovation (the area's median times the size) and how sure it is."""
    value = F.when((median_m2 > 0) & (m2 > 0), median_m2 * m2)
    return value, F.when(value.isNotNull(), F.when(sample >= SURE_SAMPLE, "high").otherwise("low"))


def flip(value: Column, price: Column, repair: Column) -> tuple[Column, Column]:
    """Margin of buying, renovating and selling, in euros and as a share of what is laid out; null if anything is unknown."""
    buffer = price * (RESALE_PERCENT / 100)
    margin = F.when(price > 0, value - price - repair - buffer)
    return margin, F.try_divide(margin, price + repair + buffer)
