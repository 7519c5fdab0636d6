"""Country -> continent generalization (C10-C14) as a distinct-values lookup.

The public dictionary below holds the sovereign states of ISO 3166-1 and a few territories (short
name, alpha-2, alpha-3, continent code, optional common name). Other territories give ``Other``. Matching is
done once per distinct raw value: exact (case-insensitive) on name, common
name or codes, then a fuzzy fallback, then ``Other``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.similarity import weighted
from umbra.functions.text import normalize_country

# Aliases applied after normalization.
SPECIAL_CASES = {
    "England": "United Kingdom",
    "Scotland": "United Kingdom",
    "Wales": "United Kingdom",
    "Yugoslavia": "Serbia",
    "Outlying US": "United States",
    "South": "Other",
}

# Minimum fuzzy score to accept a match.
FUZZY_MIN_SCORE = 80

# States of ISO 3166-1: name|alpha2|alpha3|continent|common name
_COUNTRY_TABLE = """
Afghanistan|AF|AFG|AS|
Albania|AL|ALB|EU|
Algeria|DZ|DZA|AF|
Andorra|AD|AND|EU|
Angola|AO|AGO|AF|
Antigua and Barbuda|AG|ATG|NA|
Argentina|AR|ARG|SA|
Armenia|AM|ARM|AS|
Australia|AU|AUS|OC|
Austria|AT|AUT|EU|
Azerbaijan|AZ|AZE|AS|
Bahamas|BS|BHS|NA|
Bahrain|BH|BHR|AS|
Bangladesh|BD|BGD|AS|
Barbados|BB|BRB|NA|
Belarus|BY|BLR|EU|
Belgium|BE|BEL|EU|
Belize|BZ|BLZ|NA|
Benin|BJ|BEN|AF|
Bhutan|BT|BTN|AS|
Bolivia, Plurinational State of|BO|BOL|SA|Bolivia
Bosnia and Herzegovina|BA|BIH|EU|
Botswana|BW|BWA|AF|
Brazil|BR|BRA|SA|
Brunei Darussalam|BN|BRN|AS|Brunei
Bulgaria|BG|BGR|EU|
Burkina Faso|BF|BFA|AF|
Burundi|BI|BDI|AF|
Cabo Verde|CV|CPV|AF|Cape Verde
Cambodia|KH|KHM|AS|
Cameroon|CM|CMR|AF|
Canada|CA|CAN|NA|
Central African Republic|CF|CAF|AF|
Chad|TD|TCD|AF|
Chile|CL|CHL|SA|
China|CN|CHN|AS|
Colombia|CO|COL|SA|
Comoros|KM|COM|AF|
Congo|CG|COG|AF|
Congo, The Democratic Republic of the|CD|COD|AF|
Costa Rica|CR|CRI|NA|
Côte d'Ivoire|CI|CIV|AF|Ivory Coast
Croatia|HR|HRV|EU|
Cuba|CU|CUB|NA|
Cyprus|CY|CYP|AS|
Czechia|CZ|CZE|EU|Czech Republic
Denmark|DK|DNK|EU|
Djibouti|DJ|DJI|AF|
Dominica|DM|DMA|NA|
Dominican Republic|DO|DOM|NA|
Ecuador|EC|ECU|SA|
Egypt|EG|EGY|AF|
El Salvador|SV|SLV|NA|
Equatorial Guinea|GQ|GNQ|AF|
Eritrea|ER|ERI|AF|
Estonia|EE|EST|EU|
Eswatini|SZ|SWZ|AF|Swaziland
Ethiopia|ET|ETH|AF|
Fiji|FJ|FJI|OC|
Finland|FI|FIN|EU|
France|FR|FRA|EU|
Gabon|GA|GAB|AF|
Gambia|GM|GMB|AF|
Georgia|GE|GEO|AS|
Germany|DE|DEU|EU|
Ghana|GH|GHA|AF|
Greece|GR|GRC|EU|
Grenada|GD|GRD|NA|
Guam|GU|GUM|OC|
Guatemala|GT|GTM|NA|
Guinea|GN|GIN|AF|
Guinea-Bissau|GW|GNB|AF|
Guyana|GY|GUY|SA|
Haiti|HT|HTI|NA|
Holy See|VA|VAT|EU|Vatican City
Honduras|HN|HND|NA|
Hong Kong|HK|HKG|AS|
Hungary|HU|HUN|EU|
Iceland|IS|ISL|EU|
India|IN|IND|AS|
Indonesia|ID|IDN|AS|
Iran, Islamic Republic of|IR|IRN|AS|Iran
Iraq|IQ|IRQ|AS|
Ireland|IE|IRL|EU|
Israel|IL|ISR|AS|
Italy|IT|ITA|EU|
Jamaica|JM|JAM|NA|
Japan|JP|JPN|AS|
Jordan|JO|JOR|AS|
Kazakhstan|KZ|KAZ|AS|
Kenya|KE|KEN|AF|
Kiribati|KI|KIR|OC|
Korea, Democratic People's Republic of|KP|PRK|AS|North Korea
Korea, Republic of|KR|KOR|AS|South Korea
Kuwait|KW|KWT|AS|
Kyrgyzstan|KG|KGZ|AS|
Lao People's Democratic Republic|LA|LAO|AS|Laos
Latvia|LV|LVA|EU|
Lebanon|LB|LBN|AS|
Lesotho|LS|LSO|AF|
Liberia|LR|LBR|AF|
Libya|LY|LBY|AF|
Liechtenstein|LI|LIE|EU|
Lithuania|LT|LTU|EU|
Luxembourg|LU|LUX|EU|
Madagascar|MG|MDG|AF|
Malawi|MW|MWI|AF|
Malaysia|MY|MYS|AS|
Maldives|MV|MDV|AS|
Mali|ML|MLI|AF|
Malta|MT|MLT|EU|
Marshall Islands|MH|MHL|OC|
Mauritania|MR|MRT|AF|
Mauritius|MU|MUS|AF|
Mexico|MX|MEX|NA|
Micronesia, Federated States of|FM|FSM|OC|
Moldova, Republic of|MD|MDA|EU|Moldova
Monaco|MC|MCO|EU|
Mongolia|MN|MNG|AS|
Montenegro|ME|MNE|EU|
Morocco|MA|MAR|AF|
Mozambique|MZ|MOZ|AF|
Myanmar|MM|MMR|AS|Burma
Namibia|NA|NAM|AF|
Nauru|NR|NRU|OC|
Nepal|NP|NPL|AS|
Netherlands|NL|NLD|EU|
New Zealand|NZ|NZL|OC|
Nicaragua|NI|NIC|NA|
Niger|NE|NER|AF|
Nigeria|NG|NGA|AF|
North Macedonia|MK|MKD|EU|Macedonia
Norway|NO|NOR|EU|
Oman|OM|OMN|AS|
Pakistan|PK|PAK|AS|
Palau|PW|PLW|OC|
Palestine, State of|PS|PSE|AS|Palestine
Panama|PA|PAN|NA|
Papua New Guinea|PG|PNG|OC|
Paraguay|PY|PRY|SA|
Peru|PE|PER|SA|
Philippines|PH|PHL|AS|
Poland|PL|POL|EU|
Portugal|PT|PRT|EU|
Puerto Rico|PR|PRI|NA|
Qatar|QA|QAT|AS|
Romania|RO|ROU|EU|
Russian Federation|RU|RUS|EU|Russia
Rwanda|RW|RWA|AF|
Saint Kitts and Nevis|KN|KNA|NA|
Saint Lucia|LC|LCA|NA|
Saint Vincent and the Grenadines|VC|VCT|NA|
Samoa|WS|WSM|OC|
San Marino|SM|SMR|EU|
Sao Tome and Principe|ST|STP|AF|
Saudi Arabia|SA|SAU|AS|
Senegal|SN|SEN|AF|
Serbia|RS|SRB|EU|
Seychelles|SC|SYC|AF|
Sierra Leone|SL|SLE|AF|
Singapore|SG|SGP|AS|
Slovakia|SK|SVK|EU|
Slovenia|SI|SVN|EU|
Solomon Islands|SB|SLB|OC|
Somalia|SO|SOM|AF|
South Africa|ZA|ZAF|AF|
South Sudan|SS|SSD|AF|
Spain|ES|ESP|EU|
Sri Lanka|LK|LKA|AS|
Sudan|SD|SDN|AF|
Suriname|SR|SUR|SA|
Sweden|SE|SWE|EU|
Switzerland|CH|CHE|EU|
Syrian Arab Republic|SY|SYR|AS|Syria
Taiwan, Province of China|TW|TWN|AS|Taiwan
Tajikistan|TJ|TJK|AS|
Tanzania, United Republic of|TZ|TZA|AF|Tanzania
Thailand|TH|THA|AS|
Timor-Leste|TL|TLS|AS|East Timor
Togo|TG|TGO|AF|
Tonga|TO|TON|OC|
Trinidad and Tobago|TT|TTO|NA|
Tunisia|TN|TUN|AF|
Turkey|TR|TUR|AS|
Turkmenistan|TM|TKM|AS|
Tuvalu|TV|TUV|OC|
Uganda|UG|UGA|AF|
Ukraine|UA|UKR|EU|
United Arab Emirates|AE|ARE|AS|
United Kingdom|GB|GBR|EU|
United States|US|USA|NA|
Uruguay|UY|URY|SA|
Uzbekistan|UZ|UZB|AS|
Vanuatu|VU|VUT|OC|
Venezuela, Bolivarian Republic of|VE|VEN|SA|Venezuela
Viet Nam|VN|VNM|AS|Vietnam
Virgin Islands, U.S.|VI|VIR|NA|
Yemen|YE|YEM|AS|
Zambia|ZM|ZMB|AF|
Zimbabwe|ZW|ZWE|AF|
"""


def country_rows() -> list[tuple[str, str, str, str, str | None]]:
    rows = []
    for line in _COUNTRY_TABLE.strip().splitlines():
        name, a2, a3, cont, common = line.split("|")
        rows.append((name, a2, a3, cont, common or None))
    return rows


def _dict_array() -> Column:
    """The dictionary as one constant-folded literal (fixed size, shipped inside the plan)."""
    data = [{"name": n, "cont": c, "common": common or "", "a2": a2, "a3": a3} for n, a2, a3, c, common in country_rows()]
    return F.from_json(F.lit(json.dumps(data)),
                       "array<struct<name:string,cont:string,common:string,a2:string,a3:string>>")


def exact_keys() -> dict[str, str]:
    """Lower-cased name / common name / codes -> continent; the first dictionary entry wins."""
    out: dict[str, str] = {}
    for n, a2, a3, c, common in country_rows():
        for key in (n, common, a2, a3):
            if key:
                out.setdefault(key.lower(), c)
    return out


def _exact_map() -> Column:
    return F.from_json(F.lit(json.dumps(exact_keys())), "map<string,string>")


def _alias_map() -> Column:
    return F.from_json(F.lit(json.dumps(SPECIAL_CASES)), "map<string,string>")


def fuzzy_score(a: Column, b: Column) -> Column:
    """Weighted likeness 0..100 of two names, whatever their case."""
    return weighted(F.lower(a), F.lower(b))


def country_name(raw: Column) -> Column:
    """C10 + C11: normalized name after the fixed aliases."""
    norm = normalize_country(raw)
    return F.coalesce(F.element_at(_alias_map(), norm), norm)


def exact_continent(name: Column) -> Column:
    """Exact lookup (case-insensitive on name, common name, alpha-2, alpha-3)."""
    return F.element_at(_exact_map(), F.lower(name))


def fuzzy_best(name: Column) -> Column:
    """Best (score, -position, continent) over the dictionary; ties go to the earliest entry."""
    return F.array_max(F.transform(_dict_array(), lambda d, i: F.struct(
        fuzzy_score(name, d["name"]).alias("score"), F.negate(i).alias("neg_pos"), d["cont"].alias("cont"))))


def continent_of(raw: Column) -> Column:
    """Continent code of one raw country value (exact, alias, then fuzzy fallback)."""
    name = country_name(raw)
    best = fuzzy_best(name)
    fuzzy = F.when(best["score"] >= F.lit(float(FUZZY_MIN_SCORE)), best["cont"])
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), F.lit("Other"))
        .when(name == F.lit("Other"), F.lit("Other"))
        .otherwise(F.coalesce(exact_continent(name), fuzzy, F.lit("Other")))
    )


def continent_lookup(df: DataFrame, src: str, out: str = "continent_code") -> DataFrame:
    """C14 distributed: match each *distinct* value once, then join the small result back.

    The join is a plain equi-join: AQE turns it into a broadcast when the
    distinct table measures small at run time, else a skew-aware sort-merge join.
    """
    key = f"`{src}`"
    mapping = (df.select(F.col(key).alias("__raw")).where(F.col("__raw").isNotNull()).distinct()
               .select("__raw", continent_of(F.col("__raw")).alias(out)))
    joined = df.join(mapping, df[key].eqNullSafe(mapping["__raw"]), "left").drop("__raw")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit("Other")))
