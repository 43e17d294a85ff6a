"""Fixed vocabularies, bounds and column names of the listing domain.

Everything here is data. Rules that need logic live with the functions that apply them.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Column names of the listing contract.
# ---------------------------------------------------------------------------
URL = "url_anuncio"
TITLE = "titulo"
PRICE = "preco_venda"
ADDRESS = "endereco_completo"
DESCRIPTION = "descricao_completa"
PLACE = "bairro"
AREA = "area_util"
TOTAL_AREA = "area_total"
ORIGIN = "origem_anuncio"
EXTRAS = "diferenciais_unicos"
BEACH_DISTANCE = "distancia_praia_m"

RAW_LISTING_COLUMNS = [
    "url_anuncio", "titulo", "preco_venda", "endereco_completo", "area_util", "area_total",
    "quartos", "suites", "banheiros", "garagens", "vagas", "condominio", "iptu", "bairro",
    "comodidades_area_privativa", "comodidades_area_comum", "comodidades_imovel",
    "anunciante", "codigo_imovel", "descricao_completa",
]

FREE_TEXT_COLUMNS = [
    "titulo", "endereco_completo", "descricao_completa", "comodidades_area_privativa",
    "comodidades_area_comum", "comodidades_imovel", "diferenciais_unicos", "codigo_imovel",
    "anunciante", "distancia_praia_m",
]

MONEY_COLUMNS = ["preco_venda", "condominio", "iptu"]
FEE_COLUMNS = ["condominio", "iptu"]
NUMERIC_TEXT_COLUMNS = [
    "preco_venda", "area_util", "area_total", "quartos", "suites", "banheiros", "garagens",
    "vagas", "condominio", "iptu",
]
REPAIRABLE_COLUMNS = ["suites", "banheiros", "quartos", "garagens", "vagas", "area_util"]
MODEL_NUMERIC_COLUMNS = [
    "area_util", "area_total", "quartos", "suites", "banheiros", "garagens", "condominio", "iptu",
]
CATEGORICAL_COLUMNS = ["posicao_solar", "status_construcao", "tipo_unidade", "origem_anuncio"]

# Tokens that mean "no value", the exemption word and the missing-description text.
NULL_TOKENS = ["", "None", "null", "Nao informado", "nan", "--"]
FEE_EXEMPT = "isento"
NO_DESCRIPTION = "Descrição não encontrada."
UNKNOWN_PLACE = "nao_informado"
OTHER_PLACES = "outros"
UNINFORMATIVE_PLACES = ["joao pessoa", "pb", "paraiba"]

# Plausible closed ranges per numeric column.
PLAUSIBLE_RANGES = {
    "preco_venda": (20_000.0, 50_000_000.0),
    "area_util": (15.0, 2_000.0),
    "area_total": (15.0, 5_000.0),
    "quartos": (0.0, 10.0),
    "suites": (0.0, 10.0),
    "banheiros": (0.0, 15.0),
    "garagens": (0.0, 10.0),
    "condominio": (0.0, 20_000.0),
    "iptu": (0.0, 100_000.0),
}

# The letters folded for linkage, and what they become.
FOLD_FROM = "áàãâäéêëíîïóôõöúûüç"
FOLD_TO = "aaaaaeeeiiioooouuuc"
FOLD_SEPARATORS = "-_/,"

# Place gazetteer, in match order.
GAZETTEER = [
    "manaira", "bessa", "cabo branco", "jardim oceania", "altiplano", "aeroclube", "tambaú",
    "tambau", "bancarios", "jardim cidade universitaria", "portal do sol", "torre", "estados",
    "expedicionarios", "ipês", "ipes", "bessa norte", "intermares", "miramar", "tambauzinho",
    "bessa sul", "castelo branco", "manguinhos", "jaguaribe", "centro", "varadouro",
    "agua fria", "anatólia", "anatolia", "cristo redentor", "geisel",
]

# Canonical place names by URL slug.
PLACE_NAMES = {
    "manaira": "Manaíra",
    "jardim oceania": "Jardim Oceania",
    "cabo branco": "Cabo Branco",
    "tambau": "Tambaú",
    "bessa": "Bessa",
    "gramame": "Gramame",
    "aeroclube": "Aeroclube",
    "mucumagro": "Muçumagro",
    "paratibe": "Paratibe",
    "ernesto geisel": "Ernesto Geisel",
    "jardim cidade universitaria": "Jardim Cidade Universitária",
    "altiplano cabo branco": "Altiplano Cabo Branco",
    "miramar": "Miramar",
    "bancarios": "Bancários",
    "treze de maio": "Treze de Maio",
    "cristo redentor": "Cristo Redentor",
    "jardim veneza": "Jardim Veneza",
    "planalto boa esperanca": "Planalto Boa Esperança",
    "brisamar": "Brisamar",
    "ernani satiro": "Ernâni Sátiro",
    "jardim sao paulo": "Jardim São Paulo",
    "valentina de figueiredo": "Valentina de Figueiredo",
    "torre": "Torre",
}

# Controlled amenity vocabulary, token -> (amenity, category).
AMENITY_TOKENS = {
    "piscina": ("pool", "leisure"),
    "piscina infantil": ("pool", "leisure"),
    "academia": ("gym", "leisure"),
    "playground": ("playground", "leisure"),
    "brinquedoteca": ("playground", "leisure"),
    "salão de festas": ("party_hall", "leisure"),
    "salão multiuso": ("party_hall", "leisure"),
    "sala(s) de convenções": ("party_hall", "leisure"),
    "salão de jogos": ("game_room", "leisure"),
    "churrasqueira": ("bbq_area", "leisure"),
    "churrasqueira coletiva": ("bbq_area", "leisure"),
    "churrasqueira(s) coletiva(s)": ("bbq_area", "leisure"),
    "espaço gourmet": ("gourmet_area", "leisure"),
    "varanda gourmet": ("gourmet_area", "leisure"),
    "cozinha gourmet": ("gourmet_area", "leisure"),
    "sauna": ("sauna", "leisure"),
    "quadra de esporte": ("sports_court", "leisure"),
    "cinema": ("cinema", "leisure"),
    "spa": ("spa", "leisure"),
    "sala de massagem": ("spa", "leisure"),
    "hidromassagem": ("spa", "leisure"),
    "adega": ("wine_cellar", "leisure"),
    "vista para o mar": ("sea_view", "view"),
    "portaria 24h": ("security_24h", "security"),
    "segurança 24h": ("security_24h", "security"),
    "segurança monitorada": ("security_24h", "security"),
    "sistema de câmeras": ("security_24h", "security"),
    "circuito interno de tv": ("security_24h", "security"),
    "alarme": ("security_24h", "security"),
    "portão eletrônico": ("security_24h", "security"),
    "portaria": ("concierge", "security"),
    "guarita": ("concierge", "security"),
    "bicicletário": ("bike_rack", "convenience"),
    "coworking": ("coworking", "convenience"),
    "escritório": ("coworking", "convenience"),
    "lavanderia": ("laundry", "convenience"),
    "lavanderia compartilhada": ("laundry", "convenience"),
    "gerador de energia": ("generator", "convenience"),
    "ar condicionado": ("air_conditioning", "convenience"),
    "infraestrutura de ar condicionado": ("air_conditioning", "convenience"),
    "ambiente climatizado": ("air_conditioning", "convenience"),
    "interfone": ("intercom", "convenience"),
}

# Tokens and description keywords behind the four boolean property fields.
KEYWORD_FLAGS = {
    "has_elevator": (["elevador(es)", "elevador(es) de serviço"], ["elevador"]),
    "furnished": (["mobiliado"], ["mobiliado"]),
    "pets_allowed": (
        ["aceita pet", "aceita animais", "área para pets"],
        ["aceita pet", "aceita animais", "pet friendly"],
    ),
    "has_balcony": (["sacada", "varanda"], ["varanda", "sacada"]),
}


@dataclass(frozen=True)
class SynonymRule:
    """`canonical` applies when any of `words` occurs and, if given, any of `along_with` too.

    `canonical=None` keeps the term as it is and stops the search.
    """

    canonical: str | None
    words: tuple[str, ...]
    along_with: tuple[str, ...] = field(default=())


# Synonym rules, first match wins.
SYNONYM_RULES = [
    SynonymRule("churrasqueira", ("churrasqueira",)),
    SynonymRule("piscina", ("piscina",)),
    SynonymRule(
        "portaria_seguranca_24h",
        ("portaria", "seguranca", "guarita", "camera", "circuito", "vigilancia", "porteiro",
         "portao", "cerca"),
    ),
    SynonymRule("elevador", ("elevador",)),
    SynonymRule("varanda_gourmet", ("varanda", "sacada"), ("gourmet",)),
    SynonymRule("varanda", ("varanda", "sacada")),
    SynonymRule("quadra_esportiva", ("quadra", "campo", "squash", "tenis", "futebol")),
    SynonymRule("vaga_garagem", ("garagem", "estacionamento", "vaga")),
    SynonymRule("permitido_pets", ("pet", "animais")),
    SynonymRule("carregador_carro_eletrico", ("eletrico", "eletrica"), ("carro", "veiculo")),
    SynonymRule(None, ("eletrico", "eletrica")),
    SynonymRule(
        "coworking_escritorio", ("coworking", "escritorio", "workspace", "reuniao", "convenc")
    ),
    SynonymRule("academia", ("academia", "fitness", "ginastica", "pilates")),
    SynonymRule(
        "moveis_armarios_planejados", ("armario", "planejado", "projetado", "embutido")
    ),
    SynonymRule("brinquedoteca_kids", ("brinquedoteca", "kids")),
    SynonymRule("playground", ("playground",)),
    SynonymRule("salao_de_jogos", ("jogos", "xadrez")),
    SynonymRule("salao_de_festas", ("festas",)),
    SynonymRule("espaco_gourmet", ("gourmet",)),
    SynonymRule("vista_ou_acesso_praia", ("mar", "praia")),
    SynonymRule("piso_porcelanato", ("porcelanato",)),
    SynonymRule("piso_ceramica", ("ceramica",)),
    SynonymRule("cozinha", ("cozinha",)),
    SynonymRule("lavanderia", ("lavanderia",)),
    SynonymRule("gerador_de_energia", ("gerador",)),
    SynonymRule("hall_de_entrada", ("hall",)),
    SynonymRule("acessibilidade_pne", ("pne", "acessibilidade")),
    SynonymRule("ar_condicionado", ("ar_condicionado", "climatizado")),
    SynonymRule("gas_canalizado", ("gas",)),
    SynonymRule("pista_caminhada_cooper", ("pista", "cooper", "caminhada", "trilha")),
    SynonymRule("dependencia_empregados", ("dependencia", "funcionari")),
    SynonymRule("cinema", ("cinema", "theater", "video")),
    SynonymRule("fechadura_digital", ("fechadura",)),
    SynonymRule("spa_hidromassagem", ("spa", "hidro", "jacuzzi", "banheira")),
    SynonymRule("janela_aluminio", ("aluminio",)),
]

# Flag names the synonym rules must leave alone.
SYNONYM_EXCEPTIONS = ["supermercado", "supermercados", "carpete"]

# Flags that name no amenity.
GENERIC_FLAGS = [
    "apartamento", "sala", "quarto", "01_quarto", "suite", "01_suite", "suites", "banheiros",
    "conforto", "lazer", "praticidade", "localizacao_privilegiada", "vaga_garagem",
]

# Words that mark a portal-B token as a room count, not an amenity.
NON_AMENITY_WORDS = ["m²", "quarto", "banheiro", "vaga", "andar", "suíte"]

# Flag prefixes and feature-matrix thresholds.
SCRAPED_FLAG_PREFIX = "comodidade_"
FLAG_PREFIX = "com_"
MIN_FLAG_SHARE = 0.01
MAX_DUMMY_SHARE = 0.99
MIN_LISTINGS_PER_PLACE = 30
MIN_AMENITY_LISTINGS = 20
REDUNDANT_CORRELATION = 0.85
ARTIFACT_CORRELATION = 0.50

# Number words and the fields read from prose, with their unit words and range.
NUMBER_WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6,
    "sete": 7,
}
PROSE_FIELDS = {
    "quartos": ("quartos?|dormitorios?|dorms?", 0, 10),
    "suites": ("suites?", 0, 10),
    "banheiros": ("banheiros?", 0, 15),
    "garagens": ("vagas?", 0, 10),
}

# Enumerations of the extraction record and their defaults.
EXTRACTION_ENUMS = {
    "posicao_solar": (["Nascente", "Poente", "Sul", "Norte"], "Nao informado"),
    "status_construcao": (
        ["Na planta", "Em construcao", "Pronto para morar", "Usado"], "Nao informado",
    ),
    "tipo_unidade": (
        ["Terreo com area", "Terreo simples", "Cobertura", "Duplex", "Apartamento tipo"],
        "Apartamento tipo",
    ),
}
TRUE_WORDS = ["true", "sim", "yes", "1"]

# Terms used when no term ranking is at hand.
DEFAULT_TERMS = [
    "piscina", "academia", "cozinha", "apartamento", "wc_social", "elevador",
    "salão_de_festas", "espaço_gourmet", "sala", "lavanderia", "área_de_serviço", "varanda",
    "coworking", "conforto", "01_vaga_de_garagem", "churrasqueira", "bicicletário",
    "posicao_solar_nascente", "lazer", "playground", "salão_de_jogos", "vaga_de_garagem",
    "praticidade", "recepção", "terreo_com_area_privativa", "segurança", "01_quarto", "quarto",
    "brinquedoteca", "aceita_fgts", "restaurante", "aceita_permuta", "restaurantes",
    "automacao_residencial", "em_construcao", "distancia_200m_da_praia", "entrega_em_2026",
    "moveis_planejados_na_cozinha", "01_suíte", "lounge", "supermercados", "praia",
    "localização_privilegiada", "suíte", "1_vaga_de_garagem",
]
MAX_TERMS = 45
MIN_TERM_COUNT = 5

# Token-volume estimate per listing text.
CHARS_PER_TOKEN = 3.7
PROMPT_TOKENS_PER_ROW = 150
OUTPUT_TOKENS_PER_ROW = 80

# Validation settings and search grids.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
RIDGE_ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]
#: Boosting stops early on training sets of more rows.
EARLY_STOP_ABOVE = 10_000
BOOSTING_GRID = {
    "learning_rate": [0.05, 0.1],
    "max_iter": [500],
    "max_leaf_nodes": [31, 63, 127, 255],
    "min_samples_leaf": [20, 50],
    "l2_regularization": [0.0, 1.0],
}
BOOSTING_DEFAULT = {
    "learning_rate": 0.1, "max_iter": 100, "max_leaf_nodes": 31, "min_samples_leaf": 20,
    "l2_regularization": 0.0,
}
BOOSTING_TUNED = {
    "learning_rate": 0.05, "max_iter": 500, "max_leaf_nodes": 127, "min_samples_leaf": 20,
    "l2_regularization": 0.0,
}


def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base character plus marks."""
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        kept = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(kept) == 1 and kept[0] != char:
            source.append(char)
            target.append(kept[0])
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accent_table()
