import pytest

from voxframe.llm.encoding import WRONG_ENCODINGS, misread, repair

SAMPLES = ["más árboles", "Bücherei geöffnet", "Près du marché", "calçada e iluminação", "It’s 30° in there — “safe”"]
CORRECT = [
    "MANUTENÇÃO…", "«Ça va»", "Château Âge d’or", "A CÂMARA: agora", "NÃO ACEITO, SÃO PROMESSAS", "£20 & ©2020 –", "Ånäset ± 5°", "DA MANHÃ… às seis", "DE MANHÃ, SEMPRE",
    "“IRMû", "日本語のコメント", "Привет, Россия", "Γειά σου Κόσμε", "🙂 ok", "", "plain",
]


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
@pytest.mark.parametrize("text", SAMPLES)
def test_round_trip(text, encoding):
    assert encoding in WRONG_ENCODINGS
    garbled, restored = repair(misread(text.encode(), encoding))
    assert garbled and restored == text


@pytest.mark.parametrize("text", SAMPLES)
def test_twice(text):
    assert repair(misread(misread(text.encode(), "cp1252").encode(), "cp1252")) == (True, text)


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_stays(text):
    assert repair(text) == (False, text)


SCRIPTS = {
    "Cyrillic": "Пожалуйста, почините дорогу", "Greek": "Παρακαλώ φτιάξτε τον δρόμο", "Han": "道路を直してください", "Vietnamese": "Tiếng Việt đường phố", "Hebrew": "אנא תקנו את הכביש", "Hangul": "도로를 고쳐 주세요",
}


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1254", "koi8-r"])
@pytest.mark.parametrize("script", SCRIPTS)
def test_every_script(script, encoding):
    assert repair(misread(SCRIPTS[script].encode(), encoding)) == (True, SCRIPTS[script])


@pytest.mark.parametrize("written,wrong,text", [
    ("cp1252", "mac_roman", "El niño está aquí y el café también"), ("cp1252", "cp437", "Die Bücherei ist geöffnet für alle"), ("cp1252", "cp850", "El niño está aquí y el café también"),
    ("cp1252", "cp1251", "A calçada não está em ordem, há lixo"), ("cp850", "cp1252", "A calçada não vê o niño, só a bücher"), ("cp1251", "latin-1", "Пожалуйста, почините дорогу у школы"), ("cp1251", "cp1252", "Привет, соседи"),
    ("koi8-r", "latin-1", "Пожалуйста, почините дорогу у школы"), ("cp866", "mac_roman", "Пожалуйста, почините дорогу"), ("iso8859-5", "cp1252", "Пожалуйста, почините дорогу"), ("cp1253", "cp1252", "Παρακαλώ φτιάξτε τον δρόμο"),
    ("cp866", "koi8-r", "Пожалуйста, почините дорогу"), ("mac_cyrillic", "latin-1", "почините дорогу у школы"),
])
def test_one_single_byte_encoding_read_as_another(written, wrong, text):
    assert repair(misread(text.encode(written), wrong)) == (True, text)


def test_small_letters_for_capitals():
    """Cyrillic read in another Cyrillic encoding: capitals stand where they may not."""
    garbled, restored = repair(misread("Привет, Соседи Нашего Дома".encode("koi8-r"), "cp1251"))
    assert garbled and restored == "Привет, Соседи Нашего Дома"


MULTILINGUAL = [
    "Уже хуже, чем раньше: закрытые туалеты, общий сад", "открыть детский клуб и посадить деревья", "Скамейки у дома – уже 6 лет…", "МЫ ХОТИМ ПАРК", "«Ça va» Les aînés n'osent plus", "Mi teléfono es █████. La fuga está en ████.",
    "overﬂowing ﬁelds", "думают o пepеeздe, потому что", "Καλημέρα σε όλους", "ΔΕΝ ΥΠΑΡΧΕΙ ΦΩΣ", "שלום לכולם", "مرحبا بالجميع", "Tiếng Việt", "col·legi i paral·lel", "naïve façade, Ærø, Åland", "Größe: 5 × 3 m²", "İstanbul’da yaşıyorum",
    "20 °C ± 1°, 5 µm", "日本語とカタカナ", "한국어 텍스트", "Łódź i Kraków są piękne", "Příliš žluťoučký kůň", "Ștefan și țară", "ESPAÑA: AÑO ÚTIL", "don’t “quote” – rock‘n’roll", "l’été, où l’on naît",
]


@pytest.mark.parametrize("text", MULTILINGUAL)
def test_correct_multilingual_text_stays(text):
    assert repair(text) == (False, text)


def test_only_spans_change():
    assert repair("El tÃºnel está más limpio") == (True, "El túnel está más limpio")


def test_lost_characters_are_a_case():
    assert repair("caf�") == (True, "caf�")
    assert repair("menosÂ bancos")[0] and repair("the free clinicÂ")[0]
    assert repair(None) == (False, None)
