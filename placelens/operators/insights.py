"""Business concepts in words, and insight texts made from evidence alone, with a check of what they claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import contains_any, js_round
from .scoring import INTENTS, intent_column, plain

#: Labels of intents, and the words of a concept with what they stand for (Vietnamese, English): fixed values. The last budget found counts.
LABELS = {"cafe": "Cafe", "seafood": "Hai san", "food": "An uong", "pub": "Quan nhau", "travel": "Diem di choi"}
CUSTOMERS = [
    (("student", "sinh vien", "hoc bai", "university", "dai hoc"), "Sinh viên", "Students"), (("tourist", "du lich", "traveler", "khach du lich", "gan bien", "beach"), "Khách du lịch", "Tourists"),
    (("family", "gia dinh"), "Gia đình", "Families"), (("office", "van phong"), "Dân văn phòng", "Office workers"),
]
BUDGETS = [(("binh dan", "gia re", "budget", "low cost", "tiet kiem"), "Tiết kiệm", "Budget"), (("cao cap", "premium", "luxury"), "Cao cấp", "Premium"), (("vua phai", "moderate", "mid range"), "Vừa phải", "Moderate")]
PRIORITIES = [
    (("quiet", "yen tinh", "hoc bai"), "Không gian yên tĩnh/học bài", "Quiet study-friendly space"), (("parking", "do xe"), "Có chỗ đỗ xe", "Parking availability"),
    (("beach", "gan bien", "bien"), "Gần biển/luồng khách du lịch", "Near beach/tourist flow"), (("school", "truong", "university", "dai hoc"), "Gần trường học/đại học", "Near schools/universities"),
    (("traffic", "giao thong", "access"), "Dễ tiếp cận/giao thông thuận tiện", "Good accessibility"),
]
DEFAULTS = {"type": ("Kinh doanh tổng quát", "General business"), "customers": ("Khách địa phương rộng", "Broad local market"), "budget": ("Chưa rõ", "Unspecified"), "priorities": ("Chưa phát hiện ràng buộc rõ", "No explicit constraint detected")}
#: Phrases that a text must not claim: fixed values.
UNSAFE = ("mật độ khách thật", "real footfall", "doanh thu chắc chắn", "guaranteed revenue")
SUPPORT = ("university", "truong", "dai hoc", "khach san", "hotel", "bien", "du lich", "van phong", "office", "mall", "shopping", "quan an", "cafe")

#: Sentences of an insight: fixed formats.
TEXT = {
    "vi": {
        "summary": "Khu vực này đạt {score}/100. Điểm mạnh đến từ demand proxy {demand}, độ khớp concept {fit} và {n} POI trong cụm dữ liệu hiện có.",
        "potential": "Các danh mục nổi bật là {categories}. Điều này cho thấy khu vực đã có hoạt động thương mại nền, nhưng đây vẫn là tín hiệu nhu cầu ước lượng từ POI/review/rating.",
        "no_category": "chưa đủ bằng chứng danh mục",
        "complementary": "POI bổ trợ đáng chú ý gồm {names}. Những điểm này có thể tạo luồng ghé chéo và làm concept dễ được phát hiện hơn.",
        "no_complementary": "Dữ liệu CSV hiện chưa đủ POI bổ trợ để kết luận mạnh.",
        "competition": "Có cạnh tranh trực tiếp: {names}. Concept cần khác biệt hóa rõ.",
        "no_competition": "Cạnh tranh trực tiếp chưa cao trong evidence pack hiện tại.",
    },
    "en": {
        "summary": "This area scores {score}/100. The opportunity is supported by a {demand} demand proxy, {fit} concept fit, and {n} POIs in the local cluster.",
        "potential": "The strongest category signals are {categories}. This suggests the area already has commercial activity that can support the concept, but the signal remains a proxy from POI/review/rating data.",
        "no_category": "not enough category evidence",
        "complementary": "Complementary POIs include {names}. These nearby categories can create cross-visits and make the area more useful for the target concept.",
        "no_complementary": "There is not enough complementary POI evidence in the current CSV to make a strong claim.",
        "competition": "Direct competition is visible: {names}. Differentiation is required.",
        "no_competition": "Direct competition is not high in the current evidence pack.",
    },
}


def fill(template: str, **slots: Column) -> Column:
    parts = template.replace("}", "{").split("{")
    return F.concat(*[slots[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def concept_fields(folded: Column, language: str = "vi") -> Column:
    """type, customers, budget, priorities of a concept in folded text."""
    at = 1 if language == "en" else 0

    def named(rules, default):
        found = F.array_distinct(F.array_compact(F.array(*[F.when(contains_any(folded, terms), F.lit(names[at])) for terms, *names in rules])))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))

    kind = intent_column(folded, normalized=True)["intent"]
    label = F.try_element_at(F.create_map(*[F.lit(x) for i in INTENTS for x in (i, LABELS[i])]), kind)
    budget = F.lit(DEFAULTS["budget"][at])
    for terms, *names in BUDGETS:
        budget = F.when(contains_any(folded, terms), F.lit(names[at])).otherwise(budget)
    general = F.when(contains_any(folded, ["restaurant", "nha hang"]), "Restaurant").otherwise(DEFAULTS["type"][at])
    return F.struct(F.coalesce(label, general).alias("type"), named(CUSTOMERS, DEFAULTS["customers"][at]).alias("customers"), budget.alias("budget"), named(PRIORITIES, DEFAULTS["priorities"][at]).alias("priorities"))


def complementary(category: Column, text: Column, direct: Column, has_intent: Column | None = None) -> Column:
    """Supports a business without competing: folded category and text. Without an intent all do."""
    if has_intent is not None:
        return ~has_intent | complementary(category, text, direct)
    return ~direct & contains_any(F.concat_ws(" ", category, text), [plain(t) for t in SUPPORT])


def percent(c: Column) -> Column:
    return F.concat(js_round(F.coalesce(c, F.lit(0.0)) * 100.0).cast("string"), F.lit("%"))


def insight(language: str, score: Column, demand: Column, fit: Column, n: Column, categories: Column, helpers: Column, rivals: Column) -> Column:
    """Texts from an area's signals; categories, helpers, rivals: lists of names, of which the first three are named."""
    t = TEXT[language]
    names = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    listed = F.when(F.size(categories) > 0, names(categories)).otherwise(t["no_category"])
    return F.struct(
        fill(t["summary"], score=score, demand=percent(demand), fit=percent(fit), n=n).alias("summary"), fill(t["potential"], categories=listed).alias("potential"),
        F.when(F.size(helpers) > 0, fill(t["complementary"], names=names(helpers))).otherwise(t["no_complementary"]).alias("complementary"),
        F.when(F.size(rivals) > 0, fill(t["competition"], names=names(rivals))).otherwise(t["no_competition"]).alias("risk"),
    )


def guardrail(text: Column, missing: Column, used: Column, allowed: Column) -> Column:
    """unknown: used ids that no evidence has; unsafe: claimed phrases that aren't stated as missing; passed."""
    low, gap = F.lower(text), F.lower(F.coalesce(missing, F.lit("")))
    unsafe = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)) & ~F.contains(gap, F.lit(p)), F.lit(p)) for p in UNSAFE]))
    unknown = F.filter(used, lambda x: ~F.array_contains(allowed, x))
    return F.struct(unknown.alias("unknown"), unsafe.alias("unsafe"), ((F.size(unknown) == 0) & (F.size(unsafe) == 0)).alias("passed"))
