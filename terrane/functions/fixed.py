"""Fixed values that results depend on: word lists, domain lists, patterns and limits."""

# --- fixed values: names -----------------------------------------------------------------------

LEGAL_FORMS = (
    "ltd", "limited", "llc", "inc", "incorporated", "plc", "co", "company", "corp", "corporation",
    "gmbh", "sa", "srl", "sarl", "bv", "nv", "ag", "lp", "llp", "pllc", "oy", "ab",
    "λτδ", "λιμιτεδ", "επε", "οε", "εε", "αε", "ικε", "μεπε", "αβεε", "ατεε",
)

PLACE_NOISE = tuple(
    (
        "limassol lemesos nicosia lefkosia larnaca larnaka paphos pafos famagusta ammochostos "
        "ayia napa protaras paralimni kyrenia cyprus kypros cy λεμεσος λευκωσια λαρνακα παφος "
        "αμμοχωστος κυπρος the and by & - | branch"
    ).split(" ")
)

GENERIC_NAME_WORDS = tuple(
    (
        "beauty salon salons studio studios hair hairs nail nails lash lashes brow brows makeup "
        "make up spa academy center centre clinic body face skin care barber barbers barbershop "
        "shop boutique lounge bar house club atelier artist artists aesthetics aesthetic cosmetics "
        "institute school permanent style styling design unisex by and the of for with"
    ).split(" ")
)

WEAK_KEYWORDS = tuple("salon studio shop store center centre services service and the for bar house lounge".split(" "))

NOT_A_CITY = ("", "unknown", "n/a", "cyprus", "kypros", "κυπρος", "republic of cyprus", "bangladesh", "greece", "ελλαδα")

# --- fixed values: emails ----------------------------------------------------------------------

EMAIL_PATTERN = (
    r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    r"(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.(?:[a-z]{2,}|xn--[a-z0-9-]+)$"
)
EMAIL_CANDIDATE = r"(?i)[a-z0-9.!#$%&'*+=?^_`{|}~-]+@[a-z0-9.-]+\.[a-z0-9-]{2,}"
EMAIL_LEADING_JUNK = r"""^[<("'\[]+"""
EMAIL_TRAILING_JUNK = r"""[.,;:!?'")\]}>]+$"""

ESCAPED_AT = r"(?i)\\u0040|\\x40|%40|&#0*64;|&#x0*40;|&commat;|＠"
ESCAPED_DOT = r"(?i)\\u002e|\\x2e|&#0*46;|&#x0*2e;|&period;|．"
BRACKETED_AT = r"(?i)\s*[\[({<]\s*(?:at|@|arroba)\s*[\])}>]\s*"
BRACKETED_DOT = r"(?i)\s*[\[({<]\s*(?:dot|\.|punto)\s*[\])}>]\s*"
JOINED_STRINGS = r"""["']\s*\+\s*["']"""

GENERIC_MAILBOXES = tuple(
    (
        "info contact contacts hello hi office sales support admin enquiries enquiry inquiries "
        "inquiry booking bookings book reservations reservation reception mail email team service "
        "services customerservice customercare care marketing hr jobs careers accounts accounting "
        "billing finance orders order shop store help general studio salon spa clinic webmaster "
        "web press media events management manager frontdesk appointments secretary grammateia "
        "plirofories kratiseis"
    ).split(" ")
)
ROLE_MAILBOXES = tuple(
    (
        "privacy dpo gdpr dataprotection data-protection data\\.protection dataprivacy "
        "legal compliance complaints complaint unsubscribe optout opt-out"
    ).split(" ")
)

FILE_ENDINGS = tuple("png jpg jpeg gif webp svg bmp ico tif tiff avif css js mjs map json xml pdf mp4 mp3 webm woff woff2 ttf".split(" "))
#: Top-level names that are reserved for ever (RFC 2606).
RESERVED_ENDINGS = ("example", "invalid", "localhost", "test")
PLACEHOLDER_DOMAIN = r"(^|\.)(example|domain|yourdomain|yoursite|yourcompany|mydomain|mysite|website|test|sample|company)\.[a-z.]+$"
TECH_DOMAINS = tuple(
    (
        "sentry.io sentry-next.wixpress.com sentry.wixpress.com wixpress.com wix.com cloudflare.com "
        "w3.org schema.org godaddy.com squarespace.com shopify.com wordpress.com wordpress.org "
        "mailchimp.com hubspot.com sendgrid.net amazonaws.com googleusercontent.com "
        "doubleclick.net jquery.com"
    ).split(" ")
)
JUNK_MAILBOX = (
    r"^(no-?reply|do-?not-?reply|donotreply|mailer-daemon|postmaster|abuse|bounces?|test|user|username|your-?name|yourname|your"
    r"|your-?email|youremail|name|you|someone|john\.?doe|jane\.?doe|firstname\.?lastname)$"
)
DISPOSABLE_DOMAINS = tuple(
    (
        "mailinator.com guerrillamail.com guerrillamail.net sharklasers.com 10minutemail.com "
        "tempmail.com temp-mail.org yopmail.com trashmail.com getnada.com dispostable.com "
        "maildrop.cc throwawaymail.com fakeinbox.com mintemail.com mohmal.com emailondeck.com "
        "tempail.com burnermail.io mailnesia.com"
    ).split(" ")
)

# --- fixed values: hosts -----------------------------------------------------------------------

PLATFORM_HOSTS = {
    "SOCIAL": (
        "instagram.com", "instagr.am", "facebook.com", "fb.com", "fb.me", "messenger.com",
        "tiktok.com", "twitter.com", "x.com", "t.co", "linkedin.com", "lnkd.in",
        "youtube.com", "youtu.be", "pinterest.com", "pin.it", "snapchat.com", "threads.net",
        "t.me", "telegram.me", "wa.me", "whatsapp.com", "viber.com", "vk.com",
    ),
    "LINK_IN_BIO": (
        "linktr.ee", "taplink.cc", "taplink.ws", "taplink.at", "beacons.ai", "lnk.bio", "linkin.bio",
        "bio.link", "campsite.bio", "msha.ke", "allmylinks.com", "hoo.be", "solo.to", "many.link",
        "tap.bio", "linkbio.co", "bio.site", "direct.me", "flow.page", "linkpop.com",
    ),
    "BOOKING": (
        "alteg.io", "altegio.com", "fresha.com", "booksy.com", "setmore.com", "simplybook.me",
        "simplybook.it", "calendly.com", "vagaro.com", "mindbodyonline.com", "mindbody.io",
        "hey-beauty.app", "dikidi.net", "dikidi.ru", "yclients.com", "planity.com", "timify.com",
        "booking.com", "opentable.com", "quandoo.com", "resdiary.com", "squareup.com", "glossgenius.com",
        "appointy.com", "acuityscheduling.com", "as.me", "zenoti.com", "phorest.com", "shedul.com",
        "easyweek.io", "heygoldie.com", "appointfix.com", "mst.link", "masters-app.ru",
    ),
    "MARKETPLACE": (
        "wolt.com", "foody.com.cy", "efood.gr", "ubereats.com", "deliveroo.com", "glovoapp.com",
        "bolt.eu", "just-eat.com", "etsy.com", "bazaraki.com", "airbnb.com", "vrbo.com",
        "expedia.com", "hotels.com", "agoda.com", "trivago.com",
    ),
    "MAPS_LISTING": (
        "google.com", "goo.gl", "g.page", "g.co", "maps.app.goo.gl", "business.google.com",
        "yelp.com", "foursquare.com", "cyprusyellowpages.com", "cyprus-yellow-pages.com", "cylex.com.cy",
        "find-open.com.cy", "infobel.com",
    ),
}
PLATFORM_BRANDS = {
    "tripadvisor": "MAPS_LISTING",
    "treatwell": "BOOKING",
    "thefork": "BOOKING",
    "amazon": "MARKETPLACE",
    "ebay": "MARKETPLACE",
    "airbnb": "MARKETPLACE",
    "booking": "BOOKING",
    "yelp": "MAPS_LISTING",
    "google": "MAPS_LISTING",
    "facebook": "SOCIAL",
    "instagram": "SOCIAL",
}
SOCIAL_NETWORKS = {
    "instagram": r"(^|\.)instagram\.com$|(^|\.)instagr\.am$",
    "facebook": r"(^|\.)facebook\.com$|(^|\.)fb\.com$|(^|\.)fb\.me$",
    "tiktok": r"(^|\.)tiktok\.com$",
    "linkedin": r"(^|\.)linkedin\.com$",
    "youtube": r"(^|\.)youtube\.com$|(^|\.)youtu\.be$",
}
TRACKING_PREFIXES = ("utm_", "mc_", "hsa_", "_hs", "pk_", "mtm_", "matomo_")
TRACKING_NAMES = (
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid",
    "li_fat_id", "igsh", "igshid", "_ga", "_gl", "_ke", "mkt_tok", "srsltid", "rdt_cid", "epik",
    "sscid", "ref_src", "s_cid", "trk", "spm", "vero_id", "oly_anon_id", "oly_enc_id", "wickedid",
)

# --- fixed values: signals of selling online -----------------------------------------------------

SHOP_SIGNALS = {
    "shopify": r"(?i)cdn\.shopify\.com|shopify\.theme|myshopify\.com",
    "woocommerce": r"(?i)woocommerce|wc-ajax=|wp-content/plugins/woocommerce",
    "magento": r"(?i)mage/cookies|magento|static/version\d+/frontend",
    "prestashop": r"(?i)prestashop|/modules/ps_shoppingcart",
    "opencart": r"(?i)index\.php\?route=(checkout|product)/",
    "wix-stores": r'(?i)wixstores|wix-ecommerce|"ecom-platform"',
    "squarespace-commerce": r"(?i)squarespace-commerce|static\.squarespace\.com/universal/scripts-compressed/commerce",
    "bigcommerce": r"(?i)cdn\d*\.bigcommerce\.com|bigcommerce",
    "ecwid": r"(?i)app\.ecwid\.com|ecwid_",
    "shopware": r"(?i)shopware",
    "etsy": r"(?i)https?://(?:www\.)?etsy\.com/(?:[a-z]{2}/)?shop/",
    "amazon": r"""(?i)https?://(?:www\.)?amazon\.(?:com|co\.uk|de|fr|it|es|nl|pl|se|com\.be|ie)/(?:shops/|stores/|s\?(?:[^"' ]*&)?me=|sp\?(?:[^"' ]*&)?seller=)""",
    "ebay": r"(?i)https?://(?:www\.)?ebay\.[a-z.]+/(?:str|usr)/",
    "skroutz": r"""(?i)https?://(?:www\.)?skroutz\.(?:gr|cy)/(?:c/\d+/[^"' ]*\?shop|m/|shop/)""",
    "allegro": r"(?i)https?://(?:www\.)?allegro\.pl/(?:uzytkownik|sklep)/",
    "bol": r"(?i)https?://(?:www\.)?bol\.com/[a-z]{2}/[a-z]{2}/w/",
    "cdiscount": r"(?i)https?://(?:www\.)?cdiscount\.com/mpv-",
    "aliexpress": r"(?i)https?://(?:[a-z]+\.)?aliexpress\.com/store/",
    "zalando": r"""(?i)https?://(?:www\.)?zalando\.[a-z.]+/[^"' ]*-brand""",
}
CART_SIGNALS = (
    r"""(?i)href=["'][^"']*/(?:cart|basket|checkout|kalathi|warenkorb|panier|carrello|carrito|koszyk)(?:[/?#"']|$)""",
    r"(?i)[?&]add-to-cart=\d+",
    r"(?iu)>\s*(?:add to (?:cart|basket|bag)|buy now|προσθήκη στο καλάθι|in den warenkorb|ajouter au panier|aggiungi al carrello|añadir al carrito)\s*<",
)

# --- fixed values: limits ------------------------------------------------------------------------

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
BOX_PAD = 0.05
GRID_CELL = 0.002
BAND_DEGREES = 0.01
MAX_EMAILS_PER_SITE = 10
E164 = r"^\+[1-9]\d{6,14}$"
#: Domains of sample data, which are never crawled.
EXAMPLE_SITE = r"(^|\.)example\.[a-z.]+$"
#: States of a place that is closed, as leads and exports see it.
CLOSED_PLACES = ("CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY")
CLOSED_STATUSES = ("permanently_closed", "temporarily_closed", "closed")
MATCH_REASONS = ("DOMAIN", "PHONE", "NAME")
REVIEW_REASONS = ("EMAIL_SYNTAX", "EMAIL_NO_MX", "EMAIL_MX_UNKNOWN", "EMAIL_ROLE", "NO_REAL_CITY", "NO_CATEGORY", "PHONE_INVALID")
STATUS_ORDER = ("NEW", "EXPORTED", "CONTACTED", "REPLIED", "ONBOARDED", "PRODUCT_ADDED")

# --- fixed values: kinds of pages, in order of priority ------------------------------------------

LINK_KINDS = {
    "CONTACT": r"contact|kontakt|epikoinon|επικοινων|get-?in-?touch|reach-?us|find-?us|βρειτε μας",
    "ABOUT": r"about|who-?we-?are|our-?story|σχετικ|ποιοι ειμαστε|ποιοι-ειμαστε|ταυτοτητα|η εταιρεια",
    "LEGAL": r"impressum|imprint|legal|terms|conditions|οροι|νομικ",
    "PRIVACY": r"privacy|gdpr|απορρητ|προσωπικα δεδομενα|προστασια δεδομενων",
}
FILE_PATH = r"(?i)\.(pdf|jpe?g|png|gif|webp|svg|ico|zip|rar|docx?|xlsx?|pptx?|mp[34]|mov|avi|css|js|xml|json)$"
APP_SHELL = r"""(?i)id=["'](root|app|__next|__nuxt)["']|__NEXT_DATA__|ng-version|data-reactroot"""
SKIPPED_ATTRIBUTES = ("src", "srcset", "style", "class", "id", "d", "data-src", "data-srcset", "href")
