"""Case decisions: gates, completeness, categories, escalation candidates, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import scores
from caseloom.functions import text as tx
from caseloom.functions.vectors import haversine

from .intake import violated

# Categories, units, gates and word lists of the default rules.
CATEGORIES = ["ROAD", "DRAINAGE_FLOOD", "WASTE", "CLEAN_WATER", "CIVIL_ADMIN", "HEALTH_SERVICE", "PUBLIC_ORDER", "TRANSPORTATION", "FIRE_RESCUE", "SOCIAL_AFFAIRS", "EDUCATION", "PARKS_HOUSING"]
UNITS = ["BINA-MARGA", "SDA", "LH", "PDAM", "DUKCAPIL", "DINKES", "SATPOL-PP", "DISHUB", "DISKAR", "DINSOS", "DISDIK", "DPKP"]
JURISDICTIONS = ["01", "02", "03"]
RISKS = ["LOW", "MEDIUM", "HIGH", "URGENT"]
PROVIDERS = ["openai", "anthropic", "google", "local"]
DATA_CLASSES = ["public", "synthetic", "internal_proxy"]
BLOCKED_MIME = ["application/octet-stream", "application/x-executable"]
IMAGE_MIME = ["image/jpeg", "image/png", "image/webp"]
CATEGORY_WORDS = [
    ("WASTE", ["sampah", "limbah"]),
    ("DRAINAGE_FLOOD", ["banjir", "drainase", "gorong"]),
    ("CLEAN_WATER", ["air", "pdam", "keruh"]),
    ("CIVIL_ADMIN", ["ktp", "dukcapil", "kk"]),
    ("HEALTH_SERVICE", ["puskesmas", "bpjs", "faskes"]),
    ("PUBLIC_ORDER", ["satpol", "tertib", "pkl"]),
    ("TRANSPORTATION", ["dishub", "rambu", "angkot", "macet"]),
    ("FIRE_RESCUE", ["kebakaran", "damkar", "api"]),
    ("SOCIAL_AFFAIRS", ["bansos", "telantar", "dinsos"]),
    ("EDUCATION", ["sekolah", "disdik", "guru"]),
    ("PARKS_HOUSING", ["taman", "pohon", "perumahan"]),
]
FIRE_WORDS = ["percikan api", "kabel meletup", "kabel listrik meletup", "tiang listrik meletup", "kebakaran", "meledak", "kobaran api", "terpercik api"]
ORDER_WORDS = ["pkl", "pedagang kaki lima", "lapak liar", "tenda liar", "jualan di trotoar", "bahu jalan dipake jualan", "trotoar dipake jualan", "balap liar", "pungli", "premanisme"]
PAVEMENT_WORDS = ["trotoar hancur", "paving hancur", "trotoar jebol", "aspal bolong"]
HAZARD_WORDS = ["bahaya", "tolong", "bantu", "darurat", "urgent", "rusak", "roboh", "tumbang", "ambles", "ambruk", "jebol", "hancur", "pecah", "bocor", "meletup", "percikan api", "kebakaran", "hangus", "asap", "banjir", "tergenang", "meluap", "mampet", "tersumbat", "sampah", "bau", "busuk", "limbah", "jatoh", "jatuh", "kepleset", "korban", "celaka", "tabrakan", "macet parah", "pungli", "pemerasan", "tawuran"]
STATUS_CUES = ["cek status", "cek tiket", "status tiket", "status laporan", "status aduan", "gimana perkembangan", "bagaimana perkembangan", "progres laporan", "cek progres", "laporan kemarin gimana", "tindak lanjut laporan saya"]
GREETINGS = ["halo", "hai", "hi", "p", "halo min", "halo admin", "selamat pagi", "selamat siang", "selamat sore", "selamat malam", "assalamualaikum", "tes", "test"]
CANCEL_CUES = ["batal", "cancel", "reset", "laporan baru", "aduan baru", "batal laporan", "batalkan", "mulai baru", "ganti aduan", "ganti laporan"]
OPINION_CUES = ["sekadar opini", "hanya pendapat", "sekadar saran", "sekadar salam", "cuma nanya opini"]
AMBIGUOUS = r"(?i)\b(?:acuan|alamat|arah|keberadaan|letak|lokasi|patokan|posisi|titik|koordinat)(?:\s+\w+){0,5}\s+(?:(?:masih\s+)?(?:belum|tidak)|kurang)\s+(?:jelas|pasti|rinci|definitif|diketahui|spesifik|terinci|terkonfirmasi|terverifikasi)\b"
AMBIGUOUS_PHRASES = [
    "patokannya belum jelas",
    "titiknya belum pasti",
    "titiknya kurang spesifik",
    "letak rincinya belum diketahui",
    "titik koordinat spesifik belum terkonfirmasi",
    "acuan titik tepatnya masih belum terinci",
    "keberadaan letak rincinya belum definitif",
    "posisi bidang pastinya belum terverifikasi",
    "petunjuk tempatnya belum lengkap",
    "informasi lokasinya belum jelas",
    "titiknya masih ambigu membingungkan",
    "posisi lapangannya belum teridentifikasi",
]
FORMAL = [r"(?i)\b(?:jl\.?|jalan)\s+[\w.\-]+", r"(?i)\brt\s*\d+\s*rw\s*\d+\b", r"(?i)\bkelurahan\s+[\w.\-]+", r"(?i)\bkecamatan\s+[\w.\-]+", r"(?i)\b(?:kota|kabupaten)\s+[\w.\-]+"]
STREET = r"(?i)\b(?:jl\.?|jalan)\s+(?!(?:rusak|berlubang|kecil|sempit|dekat|depan|sekitar|menuju|arah)\b)[a-zA-Z0-9\-]+"
NUMBER = r"(?i)\b(?:no\.?|nomor)\s*\d+\b"
LANDMARK = r"(?i)\b(?:miko mall|borma|trans studio|ciwalk|pvj|alun-alun|alun alun|gedung sate|rs immanuel|rs hasan sadikin|rshs|pasar baru|pasar caringin|pasar suci|stasiun bandung|stasiun kiaracondong|tegalega|tegallega|tegalega park|taman tegalega|lapangan tegalega|monumen bandung lautan api|gasibu|lapangan gasibu|monumen perjuangan|monju|bip|bandung indah plaza|becky|balai kota|babakan siliwangi|baksil|taman lansia|itb|unpad|upi|uin|telkom university|stt telkom|kebun binatang|bandung zoo)\b|\b(?:mall|borma|pasar|masjid|rs|rumah sakit|spbu|pom bensin|stasiun|terminal|taman|lapangan|monumen|tugu)\s+[A-Za-z0-9\-]+\b"
AREA = r"(?i)\b(?:kopo|pasteur|dago|buah batu|buahbatu|cibadak|asia afrika|riau|merdeka|supratman|gedebage|antapani|arcamanik|ciroyom|setiabudi|lembang|sukajadi|astanaanyar|lengkong|cikutra|cicadas|kiaracondong|batununggal|soekarno hatta|sukarno hatta|serayu|tegalega|tegallega|peta|bkr|mohkamad toha|moh toha|otista|otto iskandardinata|pasir koja|pasirkoja|sudirman|gardujati|andir|bojongloa|regol|sukasari|cidadap|coblong|cibeunying|bandung wetan|bandung kulon|sumur bandung)\b"
CENTROIDS = [
    ("Sumur Bandung", -6.9175, 107.6111), ("Coblong", -6.8856, 107.6144), ("Sukajadi", -6.8867, 107.5922), ("Bojongloa Kaler", -6.9389, 107.5889),
    ("Bandung Kidul", -6.9556, 107.6333), ("Lengkong", -6.9306, 107.6222), ("Cicendo", -6.9056, 107.5944), ("Astanaanyar", -6.9300, 107.6000),
    ("Regol", -6.9333, 107.6111), ("Batununggal", -6.9389, 107.6389), ("Cibeunying Kaler", -6.8944, 107.6333), ("Cibeunying Kidul", -6.9083, 107.6444),
    ("Kiaracondong", -6.9278, 107.6500), ("Buahbatu", -6.9500, 107.6556), ("Andir", -6.9111, 107.5778), ("Antapani", -6.9167, 107.6611),
    ("Arcamanik", -6.9139, 107.6806), ("Ujungberung", -6.9111, 107.7000), ("Gedebage", -6.9667, 107.6833), ("Rancasari", -6.9556, 107.6722),
]


def authority(jurisdiction: Column, category: Column) -> Column:
    """The unit of a (jurisdiction, category), null where there is none: a map of 36 entries."""
    entries = [F.lit(x) for j in JURISDICTIONS for c, u in zip(CATEGORIES, UNITS, strict=True) for x in (f"JUR-FICT-{j}/{c}", f"UNIT-{u}-{j}")]
    return F.try_element_at(F.create_map(*entries), F.concat_ws("/", jurisdiction, category))


def canonical(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(F.upper(F.trim(value)).isin(allowed), F.upper(F.trim(value))).otherwise(default)


def map_point(case_id: Column) -> Column:
    """struct(lat, lon): a stable place derived from the id."""
    h = F.conv(F.substring(F.md5(case_id.cast("string")), 1, 6), 16, 10).cast("long")
    at = lambda base, k: F.round(base + (k - 50) * 0.0008, 5)
    return F.struct(at(F.lit(-6.9175), h % 100).alias("lat"), at(F.lit(107.6191), F.floor(h / 100) % 100).alias("lon"))


def ticket_gate(jurisdiction: Column, category: Column, unit: Column, missing: Column, evidence: Column, key: Column, expected_key: Column) -> Column:
    """ALLOW or the reason of the denial; what cannot be decided is denied."""
    allowed_route = F.coalesce(authority(jurisdiction, category) == unit, F.lit(False))
    complete = F.coalesce((F.size(missing) == 0) & evidence, F.lit(False))
    return scores.first_match([(~allowed_route, "AUTHORITY_ROUTE_INVALID"), (~complete, "MANDATORY_EVIDENCE_MISSING"), (~F.coalesce(key == expected_key, F.lit(False)), "IDEMPOTENCY_KEY_INVALID")], "TICKET_CREATE_ALLOWED")


def egress_gate(provider: Column, data_class: Column, has_pii: Column, mime: Column, sensitive: Column, cost: Column, remaining: Column) -> Column:
    return scores.first_match(
        [
            (~F.coalesce(provider.isin(PROVIDERS), F.lit(False)), "PROVIDER_NOT_ON_ALLOWLIST"),
            (~F.coalesce(data_class.isin(DATA_CLASSES), F.lit(False)), "DATA_CLASS_NOT_ALLOWED"),
            (has_pii, "PII_EGRESS_BLOCKED"),
            (mime.isin(BLOCKED_MIME), "BLOCKED_MIME_TYPE"),
            (mime.isin(IMAGE_MIME) & sensitive, "SENSITIVE_IMAGE_EGRESS_DENIED"),
            (cost > remaining, "BUDGET_EXCEEDED"),
        ],
        "EGRESS_ALLOWED",
    )


def decide(complaint: Column, policy: Column, authority_valid: Column, hard: Column, blocking: Column, complete: Column, covered: Column, best_value: Column, threshold: Column, can_ask: Column) -> Column:
    """Mode/reason of a case; ``best_value`` is the value of its best feasible candidate, null for none."""
    open_issue = blocking | ~complete | ~covered
    return scores.first_match(
        [
            (~complaint, "REJECT_IGNORE/OUT_OF_SCOPE_OR_NON_COMPLAINT"),
            (~policy | ~authority_valid | hard, "RE_EVALUATE/HARD_POLICY_OR_AUTHORITY_BLOCK"),
            (open_issue & (best_value > threshold), "RE_EVALUATE/POSITIVE_VOI"),
            (open_issue & can_ask, "REQUEST_CLARIFICATION/MANDATORY_FACT_OR_CONFLICT_UNRESOLVED"),
            (open_issue, "RE_EVALUATE/BLOCKED_WITHOUT_CLARIFICATION_CAPABILITY"),
        ],
        "EXECUTE/EVIDENCE_ROUTE_POLICY_READY",
    )


def best_candidates(candidates: DataFrame, case: str) -> DataFrame:
    """(case, task_id, value): the most valuable feasible candidate of each case, ties by task id.

    Columns: policy_allowed, done, gain, usd, latency_ms, egress_bytes, queue_ms and the
    remaining budgets remaining_usd, remaining_ms, remaining_bytes.
    """
    fits = F.col("policy_allowed") & ~F.col("done") & (F.col("usd") <= F.col("remaining_usd")) & (F.col("latency_ms") + F.col("queue_ms") <= F.col("remaining_ms")) & (F.col("egress_bytes") <= F.col("remaining_bytes"))
    value = scores.information_value(F.col("gain"), F.col("usd"), F.col("latency_ms"), F.col("egress_bytes"), F.col("queue_ms"))
    best = F.min(F.struct((-value).alias("low"), F.col("task_id").alias("task_id")))
    return candidates.where(fits).groupBy(case).agg(best.alias("b")).select(case, F.col("b.task_id").alias("task_id"), (-F.col("b.low")).alias("value"))


def category_by_words(text: Column, rules: list[tuple[str, list[str]]] = CATEGORY_WORDS, default: str = "ROAD") -> Column:
    lower = F.lower(text)
    return scores.first_match([(tx.any_word(lower, words), name) for name, words in rules], default)


def priority_domain(text: Column, fire: list[str] = FIRE_WORDS, order: list[str] = ORDER_WORDS, pavement: list[str] = PAVEMENT_WORDS) -> Column:
    lower = F.lower(text)
    return F.when(tx.any_word(lower, fire), "FIRE_RESCUE").when(tx.any_word(lower, order) & ~tx.any_word(lower, pavement), "PUBLIC_ORDER")


def early_exit(text: Column, latest: Column, status: list[str] = STATUS_CUES, greetings: list[str] = GREETINGS, cancel: list[str] = CANCEL_CUES, longest: int = 80) -> Column:
    t, last = F.lower(F.trim(text)), F.lower(F.trim(latest))
    return F.when(tx.any_word(t, status) & (F.length(F.trim(text)) < longest), "STATUS").when(t.isin(greetings), "GREETING").when(last.isin(cancel) | t.isin(cancel), "CANCEL")


def complaint(text: Column, intent: Column, risk: Column, category: Column, hazard: list[str] = HAZARD_WORDS, explicit: list[str] = ("lapor", "aduan", "keluhan"), plea: list[str] = ("tolong", "min"), opinion: list[str] = OPINION_CUES) -> Column:
    lower = F.lower(text)
    danger = tx.any_word(lower, list(hazard))
    grave = risk.isin("HIGH", "URGENT") | category.isin("FIRE_RESCUE", "ROAD", "DRAINAGE_FLOOD", "CLEAN_WATER") | tx.any_word(lower, list(plea))
    yes = (intent == "COMPLAINT") | tx.any_word(lower, list(explicit)) | (danger & grave)
    return yes & ~(tx.any_word(lower, list(opinion)) & ~danger)


def completeness(text: Column, locations: Column | None = None, rules: dict | None = None, collapse: bool = True) -> Column:
    """SUFFICIENT, INCOMPLETE or AMBIGUOUS, by ordered evidence; ``locations``: texts of location entities.

    ``collapse``: runs of white space count as one space, else the text is matched as it is.  The
    street rule may be a pair: a pattern whose group 1 is a name, found one behind the other, and a pattern of what is no name.
    """
    r = {"ambiguous": [AMBIGUOUS], "phrases": AMBIGUOUS_PHRASES, "formal": FORMAL, "street": STREET, "number": NUMBER, "landmark": LANDMARK, "area": AREA} | (rules or {})
    plain = F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else text
    evidence = plain if locations is None else F.concat_ws(" ", plain, F.array_join(locations, " "))
    vague, formal = tx.any_word(F.lower(plain), r["phrases"]), F.lit(True)
    for p in r["ambiguous"]:
        vague = vague | plain.rlike(p)
    for p in r["formal"]:
        formal = formal & evidence.rlike(p)
    number, landmark, area = (evidence.rlike(r[k]) for k in ("number", "landmark", "area"))
    if isinstance(r["street"], tuple):
        name, no_name = r["street"]
        street = F.exists(F.regexp_extract_all(evidence, F.lit(name), 1), lambda w: ~w.rlike(no_name))
    else:
        street = evidence.rlike(r["street"])
    several = F.lit(False) if locations is None else (F.size(locations) >= 2) & (landmark | (street & number))
    return F.when(vague, "AMBIGUOUS").when(formal | (street & number) | (landmark & (area | street)) | (street & area) | several, "SUFFICIENT").otherwise("INCOMPLETE")


def nearest_place(lat: Column, lon: Column, places: list[tuple[str, float, float]] = CENTROIDS) -> Column:
    """Name of the nearest of a short list of places; the first one on ties."""
    options = F.array(*(F.struct(haversine(lat, lon, F.lit(a), F.lit(b)).alias("km"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(places)))
    return F.array_min(options)["name"]


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order (all descending), by partial aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(key, "_s.*")


def identity_gate(egress: Column, provider: Column, model: Column, adapter_provider: Column, adapter_model: Column) -> Column:
    """What the model gateway answers: the egress gate's reason where it denies, a mismatch of the adapter, or CALL."""
    same = F.coalesce((provider == adapter_provider) & (model == adapter_model), F.lit(False))
    return F.when(egress != "EGRESS_ALLOWED", F.concat(F.lit("DENIED/"), egress)).when(~same, "DENIED/ADAPTER_IDENTITY_MISMATCH").otherwise("CALL")


def valid_payload(spans: Column, evidence: Column, key: Column, tenant: Column, case: Column, status: Column, data: Column, confidence: Column, error: Column) -> Column:
    """Names of the rules that a payload breaks: span offsets and labels, order of evidence offsets, the canonical key, and what a status may carry."""
    good_span = lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & s["label"].isin("OBJ", "LOC", "TIME")
    good_item = lambda e: (F.length(e["ref"]) > 0) & (F.length(e["claim"]) > 0) & (F.coalesce(e["start"], F.lit(0)) >= 0) & (e["start"].isNull() | e["end"].isNull() | (e["end"] >= e["start"]))
    done = status == "SUCCEEDED"
    rules = {
        "spans": F.forall(spans, lambda s: F.coalesce(good_span(s), F.lit(False))),
        "evidence": F.forall(evidence, lambda e: F.coalesce(good_item(e), F.lit(False))),
        "key": key == F.concat_ws(":", tenant, case, F.lit("ticket:create:v1")),
        "status": F.when(done, data.isNotNull() & error.isNull()).otherwise(data.isNull() & confidence.isNull() & error.isNotNull()),
    }
    return violated(rules)


def partial_index(rows: DataFrame, predicate: Column, keys: list[str], columns: list[str] = ()) -> DataFrame:
    """The rows that a partial index holds, with its columns: what the predicate leaves, so a lookup by key reads no other row."""
    return rows.where(F.coalesce(predicate, F.lit(False))).select(*keys, *columns)


# Questions for a missing place by category, and for other fields.
LOCATION_QUESTIONS = {
    "ROAD": "Jalan rusak atau berlubang berada di ruas jalan mana dan dekat patokan apa?",
    "DRAINAGE_FLOOD": "Titik genangan atau saluran tersumbat berada di jalan mana dan dekat patokan apa?",
    "WASTE": "Tumpukan sampah berada di jalan atau lokasi mana dan dekat patokan apa?",
    "CLEAN_WATER": "Pipa bocor atau gangguan air bersih terjadi di alamat atau ruas jalan mana?",
    "CIVIL_ADMIN": "Layanan administrasi kependudukan di kantor atau kelurahan mana yang dimaksud?",
    "HEALTH_SERVICE": "Fasilitas kesehatan atau puskesmas mana yang Anda maksud?",
    "PUBLIC_ORDER": "Gangguan ketertiban umum terjadi di ruas jalan atau lokasi mana?",
    "TRANSPORTATION": "Fasilitas transportasi atau rambu di jalan/persimpangan mana yang bermasalah?",
    "FIRE_RESCUE": "Lokasi kejadian darurat (kebakaran / pohon tumbang / evakuasi) tepatnya di alamat, nomor, atau patokan mana?",
    "SOCIAL_AFFAIRS": "Warga yang membutuhkan bantuan sosial terpantau di jalan atau lokasi mana?",
    "EDUCATION": "Sekolah atau fasilitas pendidikan mana yang dimaksud?",
    "PARKS_HOUSING": "Pohon tumbang atau fasilitas taman di jalan mana dan dekat patokan apa yang mengalami kendala?",
}
FIELD_QUESTIONS = {
    "location": "Mohon sebutkan nama jalan, nomor, RT/RW, kelurahan, atau patokan lokasi spesifik aduan Anda.",
    "location_incomplete": "Alamat belum lengkap. Mohon sebutkan nama jalan, RT/RW, atau kelurahan lokasi kejadian.",
    "location_ambiguous": "Patokan lokasi yang Anda sebutkan masih ambigu. Mohon jelaskan nama kelurahan dan kecamatan atau patokan terdekat.",
    "time": "Kapan permasalahan ini mulai terjadi atau terakhir kali terpantau?",
    "issue": "Bisa jelaskan lebih detail fasilitas atau sarana apa yang mengalami kerusakan?",
    "image_fallback": "Lampiran gambar Anda tidak dapat diproses secara otomatis demi privasi. Mohon jelaskan kondisi kerusakan dan patokan lokasi secara tertulis.",
}


def question(field: Column, category: Column) -> Column:
    """The question for a missing field: that of the category for a place, of the field, of what its name hints at, else a general one."""
    of = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    norm = F.lower(F.trim(field))
    place = F.when(norm.isin("location", "location_incomplete"), F.try_element_at(of(LOCATION_QUESTIONS), category))
    hint = F.when(norm.contains("loc") | norm.contains("alamat"), FIELD_QUESTIONS["location"]).when(norm.contains("time") | norm.contains("waktu"), FIELD_QUESTIONS["time"])
    general = F.concat(F.lit("Mohon berikan informasi lebih lanjut mengenai "), field, F.lit(" agar aduan dapat kami proses."))
    return F.coalesce(place, F.try_element_at(of(FIELD_QUESTIONS), norm), hint, general)
