"""Brand and variant identity of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantryplan.functions.units import words

EXTENSION = 0.50
LONGEST = 3
TOKEN = r"[A-Za-z0-9&'.\-]+"
# Words that are no brand, descriptors, and descriptors that exclude each other.
GENERIC = ("organic", "whole", "fresh", "natural", "premium", "classic", "original", "the", "gluten", "free", "great", "good", "value", "simply", "real", "pure", "raw", "hard", "non", "extra", "dry", "red", "white", "baby", "kids")
VARIANTS = (
    "organic", "nonorganic", "unsweetened", "sweetened", "unsalted", "salted", "gluten-free", "glutenfree", "lactose-free", "dairy-free", "sugar-free",
    "fat-free", "low-fat", "lowfat", "nonfat", "reduced-fat", "light", "decaf", "decaffeinated", "caffeine-free", "kosher", "halal", "vegan",
    "grass-fed", "free-range", "cage-free", "pasture-raised", "wild-caught", "non-gmo", "keto", "plant-based", "whole", "skim", "1%", "2%",
    "frozen", "fresh", "canned", "dried", "raw", "cooked", "smoked", "roasted", "ground", "shredded", "sliced", "diced", "crushed", "creamy", "crunchy",
    "chunky", "fine", "coarse", "boneless", "skinless", "seedless", "pitted", "unbleached", "bleached", "instant", "concentrated",
    "vanilla", "chocolate", "strawberry", "blueberry", "raspberry", "banana", "peach", "mango", "lemon", "lime", "orange", "cherry", "grape", "apple",
    "coconut", "almond", "peanut", "hazelnut", "caramel", "honey", "maple", "cinnamon", "mint", "peppermint", "original", "plain", "unflavored",
    "spicy", "mild", "medium", "hot", "sweet", "sour", "smoky", "garlic", "onion", "herb", "ranch", "bbq", "barbecue", "buffalo", "sea-salt",
    "white", "brown", "black", "green", "red", "yellow", "dark", "milk", "extra-virgin", "virgin", "unrefined", "refined",
)
# Brands of the stores themselves, known rather than inferred.
STORE_BRANDS = (
    "Signature Select", "O Organics", "Value Corner", "Lucerne", "Open Nature", "Primo Taglio", "Waterfront Bistro", "Debi Lilly", "Soleil",
    "Kroger", "Simple Truth", "Private Selection", "Home Chef", "Sprouts", "Sprouts Farmers Market",
    "Friendly Farms", "Simply Nature", "Specially Selected", "Happy Farms", "Clancy's", "Millville", "Crofton", "Benton's", "Burman's", "Casa Mamita",
    "Barissimo", "Fit & Active", "Never Any", "Southern Grove", "Berryhill", "Chef's Cupboard", "Countryside Creamery", "Dakota's Pride", "Earth Grown",
    "Elevation", "Goldhen", "Little Salad Bar", "Mama Cozzi's", "Nature's Nectar", "Priano", "Pueblo Lindo", "Reggano", "Season's Choice", "Simply Gum",
    "Stonemill", "Sundae Shoppe", "Tuscan Garden", "Village Bakery",
)
# Words that are part of a size.
SIZE_LIKE = r"^(?:[\d.,/]+|oz|lb|lbs|g|kg|mg|ml|l|ct|pk|pack|fl|gal|qt|pt|x|count)$"
EXCLUSIVE = (
    ("whole", "skim", "1%", "2%", "nonfat", "low-fat", "lowfat", "reduced-fat"),
    ("frozen", "fresh", "canned", "dried"),
    ("creamy", "crunchy", "chunky"),
    ("unsweetened", "sweetened"),
    ("unsalted", "salted"),
    ("decaf", "decaffeinated", "caffeine-free", "instant"),
    ("vanilla", "chocolate", "strawberry", "blueberry", "raspberry", "banana", "peach", "mango", "lemon", "lime", "orange", "cherry", "grape", "coconut", "caramel", "honey", "maple", "cinnamon", "mint", "peppermint", "plain", "unflavored"),
    ("boneless", "skinless", "ground", "shredded", "sliced", "diced"),
)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def plausible(gram: Column) -> Column:
    parts = F.split(gram, " ")
    return (F.char_length(gram) >= 3) & ~F.exists(parts, lambda p: p.rlike("^[0-9]+$")) & ~F.forall(parts, lambda p: F.lower(p).isin(*GENERIC))


def leading_grams(title: Column) -> Column:
    ts = tokenize(title)
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: n <= F.size(ts)), lambda n: F.array_join(F.slice(ts, F.lit(1), n), " "))


def brand_lexicon(catalog: DataFrame, least: int = 5) -> DataFrame:
    """gram and how many products lead with it, of grams with at least ``least``."""
    grams = catalog.select("store_id", "product_id", F.explode(leading_grams(F.col("raw_title"))).alias("gram")).where(plausible(F.col("gram")))
    return grams.distinct().groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def brands(catalog: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``brand``: the longest leading gram of the lexicon that keeps half of the shorter one's products; else a leading store brand."""
    out, ts = catalog, tokenize(F.col("raw_title"))
    for n in range(1, LONGEST + 1):
        part = lexicon.select(F.col("gram").alias(f"g{n}"), F.col("n").alias(f"n{n}"))
        out = out.withColumn(f"g{n}", F.when(F.size(ts) >= n, F.array_join(F.slice(ts, 1, n), " "))).join(part, f"g{n}", "left")
    grows = lambda a, b: F.coalesce(F.col(b) >= EXTENSION * F.col(a), F.lit(False))
    two = F.col("n2").isNotNull() & (F.col("n1").isNull() | grows("n1", "n2"))
    three = F.col("n3").isNotNull() & ((two & grows("n2", "n3")) | (F.col("n1").isNull() & F.col("n2").isNull()))
    listed = [F.when(F.col(f"g{n}").isin(*STORE_BRANDS), F.col(f"g{n}")) for n in range(LONGEST, 0, -1)]
    found = F.when(three, F.col("g3")).when(two, F.col("g2")).when(F.col("n1").isNotNull(), F.col("g1")).otherwise(F.coalesce(*listed))
    return out.withColumn("brand", strip_generic(found)).drop(*(f"{x}{n}" for x in "gn" for n in range(1, LONGEST + 1)))


def strip_generic(brand: Column) -> Column:
    """Drop generic last words while more than one is left."""
    for _ in range(LONGEST - 1):
        parts = F.split(brand, " ")
        brand = F.when((F.size(parts) > 1) & F.lower(F.element_at(parts, -1)).isin(*GENERIC), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), " ")).otherwise(brand)
    return brand


def variant_tokens(title: Column, brand: Column) -> Column:
    """Sorted descriptors of a title without the brand's own words; a word that is none may make one with the next (``sea salt``).

    Tokens have no ``%``, so fat percentages are no descriptors of a title.
    """
    own = F.transform(tokenize(brand), F.lower)
    ts = F.transform(F.filter(F.transform(tokenize(title), F.lower), lambda t: ~F.array_contains(own, t)), lambda t: F.btrim(t, F.lit(".")))

    def descriptor(t: Column, i: Column) -> Column:
        pair = F.concat(t, F.lit("-"), F.get(ts, i + 1))
        return F.when(t.rlike(SIZE_LIKE), None).when(t.isin(*VARIANTS), t).when(pair.isin(*VARIANTS), pair)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(ts, descriptor))))


def request_identity(requests: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, brand and variants of requests: the longest run of words anywhere in the text that is a brand, the leftmost of equals."""
    ts = tokenize(F.col(text))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.transform(ts, lambda _, i: F.when(i + n <= F.size(ts), F.struct((-n).alias("n"), i.alias("i"), F.array_join(F.slice(ts, i + 1, n), " ").alias("gram"))))))
    at = requests.select(key, F.explode(F.array_compact(grams)).alias("g")).select(key, "g.*").where(plausible(F.col("gram")))
    known = at.join(lexicon.select("gram", F.lit(True).alias("known")), "gram", "left").where(F.col("known") | F.col("gram").isin(*STORE_BRANDS))
    best = known.groupBy(key).agg(F.min_by("gram", F.struct("n", "i")).alias("found"))
    out = requests.join(best, key, "left").withColumn("brand", strip_generic(F.col("found")))
    return out.select(key, "brand", variant_tokens(F.col(text), F.col("brand")).alias("variants"))


def variants_conflict(a: Column, b: Column) -> Column:
    """Both sides name members of an exclusive group, and not the same ones."""
    hits = [(F.array_sort(F.array_intersect(a, words(*g))), F.array_sort(F.array_intersect(b, words(*g)))) for g in EXCLUSIVE]
    out = F.lit(False)
    for x, y in hits:
        out = out | ((F.size(x) > 0) & (F.size(y) > 0) & (x != y))
    return out


def brand_prefix_conflict(a: Column, b: Column) -> Column:
    """Different brands, neither of which starts with the other's words."""
    x, y = F.split(F.lower(a), " "), F.split(F.lower(b), " ")
    n = F.least(F.size(x), F.size(y))
    return F.coalesce(F.slice(x, F.lit(1), n) != F.slice(y, F.lit(1), n), F.lit(False))
