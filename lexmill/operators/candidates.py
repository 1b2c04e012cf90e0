"""Candidate rules: tokens of a language that may need a normal form.

A language is data: word sets, patterns and endings. One evaluator turns them
into a column. The word sets and patterns are fixed values.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import lang_code, rx, strip, strong_protect


@dataclass(frozen=True)
class Rules:
    """``words`` and ``short`` are compared in lower case, ``exact`` as they are; ``patterns`` with the token, ``low_patterns`` with its lower case.

    ``kept`` tokens and ``kept_patterns`` are never candidates; ``allowed`` ones
    may be in spite of their protection; ``endings_unless`` is a pattern that
    makes a candidate unless another fits.
    """

    words: str = ""
    short: str = ""
    exact: str = ""
    patterns: tuple[str, ...] = ()
    low_patterns: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    kept: str = ""
    kept_patterns: tuple[str, ...] = ()
    endings_unless: tuple[str, str] = ("", "")
    protect: bool = True


REPEATED = r"([A-Za-zÀ-ž])\1{2,}"
RULES = {
    "da": Rules(
        words="pa paa p sa saa s ogsa ogs ikk ik ek vaere vre vaeret vaek sadan ma gar nar ar har made taenker taenke hjaelp hjaelpe laekker"
        " naesten saeson desvaerre idag maneder hvornr forsta laenge haevn paen naeste glaede glaeder vaerd blir fler stte fet jalouxi minpige"
        " jeq oq diq miq noqet sku squ sq hva ka ha pga fx brn mde flelser nsten prvet kraefter laes arets mal la fa krft",
        short="a p pa s sa ma r n t gr fr fa os sku la har ar nar nr ka ha va i o v j",
        low_patterns=("ae", "oe", "aa", "q"),
        patterns=(r"([A-Za-zÆØÅæøå])\1{2,}",),
    ),
    "de": Rules(
        words="nich net ned nix grad grade heut hab habs gibts gehts is ne nen nem n 'n 'ne 's ma vllt un find kenn geh werd würd wär glaub freu les"
        " bekomm scho schonmal naja achso wettendass zuhause drüber rum eh spass scheiss fuer fur ueber uber schoen koenn kannste haste willste"
        " biste isses wirds solls gesehn jaa wars",
        short="ich das was ja ne n nen nem ma hab is werd würd wär find glaub kenn freu die der und aber wie jetzt es",
        low_patterns=("fuer|fur|ueber|uber|schoen|waere|wuerd|koenn|muess|grues", r"^(?=.{5}).*(?:ae|oe|ue)"),
        patterns=(REPEATED, "[дД]"),
    ),
    "en": Rules(
        words="im ive ill id dont didnt cant wont isnt wasnt werent doesnt shouldnt couldnt wouldnt havent hasnt theyre youre thats theres whos hes"
        " shes its lets arent ain't aint u ur r n nd w wit pls plz ppl bc cuz cause tho bout abt lil bruh bro gonna wanna tryna finna ima imma"
        " gon rn af tf dm rt ty thx fav pic vid congrats dat da tha dis wat kno ya yall yo em b d c 2 4",
        patterns=(r"([A-Za-z])\1{2,}",),
        low_patterns=(r"^(?!(?:begin|within|again)$)[a-z]{3,}in$", r"^.{3,}nt$"),
        allowed=("2", "4"),
    ),
    "es": Rules(
        words="tambien despues aqui alli corazon cafe mio mia tio pais estan habra tendre muchisimo rapidas romeria movil bateria adios egocentrico"
        " maricon lio rie q k ke qe xq pq porq pa cn tb tmb esq esque esqe finde x dspue tds insti peli kiero qiero voi estoi porai queva qur"
        " aseh pasao pnsao llege pokitin",
        short="si q k ke qe pa to ma na d x mi tu tuu",
        patterns=(r"([A-Za-zÁÉÍÓÚÜÑáéíóúüñ])\1{2,}",),
        low_patterns=(r"^(?=.{4})(?:j+a+)+j*a*$",),
        endings_unless=("(?:cion|mente|isimo)$", "[áéíóúñü]"),
    ),
    "nl": Rules(
        words="ni nie nt da goe ma mr wa ff effe mss gwn wss mn m'n 't t 'n n ne nen vd vr vn nr aub idd ipv ivm aant kheb kga kben kzal kzou kmoe"
        " kwas khad kwil kweet ist tis das mja dak daje int vant omda tzal tzijn gij ge sebiet strx fdaag gister prive oke okee suc6 8er jah jaa"
        " neej owk ofsow men dr em z'n ikke kijke zitte hebk moete hebbe wete kome mense geslape drinkn",
        short="n t k ne da ma wa ge gij men gn dr na bn me my em",
        patterns=(REPEATED, "[0-9]"),
        low_patterns=(r"^k(?:heb|ga|ben|zal|zou|moe|moet|was|had|wil|weet|kom|kan|moest|had).*$",),
    ),
    "it": Rules(
        words="nn ke cn cmq cmnq nnt nov info dx sx qnd qlc qlcn qlcs qst qsto qsta qsti qste x xk xke xké xchè xche"
        " e' e’ é perchè perche' perche’ perche puo' puo’ puo pero' pero’ pero gia cosi piu citta"
        " governo monti roma italia mario pd cgil cisl uil rai bce tg1 iphone berlusconi",
        kept="lol LOL omg OMG ahahah ahah Bhe bhe tvb tvtb xoxo",
        patterns=(r"([A-Za-zÀ-ÿ])\1{2,}", r"^[A-Za-zÀ-ÿ]+['’]$"),
        endings_unless=(r"^[A-ZÀÈÉÌÍÒÓÙÚ]{3,}$", r"^(?!(?:NON|CHE|PER|DEL|DEI|CON)$)[A-Z]{2,}[0-9]*$"),
    ),
    "id": Rules(
        words="yg aja bgt ga gak gk nggak kalo klo liat pake udah udh org jd jg tp sm dr utk dlm krn bs bsa ky kyk gini gitu emg emang gue gua gw lo lu"
        " kk ka mba ny nnti kl pnjang bnr se7 wkt",
        patterns=(r"([A-Za-z])\1{2,}", r"""[A-Za-z]+(?:2|['"]{1,2})[A-Za-z]*$"""),
        low_patterns=(r"^.{2,}(?:ny|'y)$", r"^.{3,}[xq]$", r"^(?=.{5})(?:nge|ng)", r"^(?=.*\d)(?=.*[a-z])"),
    ),
    "vi": Rules(
        words="k ko khong khum hong hông hok hk kg đc dc duoc dk đk r roi rùi gòi t m mk mik e a c ng ngta ny mn mng nma nhma gđ đt sn zui dô zô j gi jz"
        " bh bt bn tr",
        patterns=(r"([A-Za-zÀ-ỹ])\1{2,}",),
        low_patterns=(
            r"^(?=.*[A-Za-zÀ-ỹ])(?!.*[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]).{1,4}$",
        ),
    ),
    "th": Rules(
        exact="เค้า นึง มั้ย จ้า ละ งี้ ยังไง อ่ะ ก้ ก้อ คับ เปน จิง โครต หรอ ไร จริงๆ มากๆ ดีๆ หลายๆ คอน เว็บ โพส แอพ ทวิต มือ2 มากกก โว้ยย ฮือออ แงงง แฟมิลี่",
        kept="555 5555 55555 ๕๕๕ ๕๕๕๕ ค่ะ คะ ครับ นะ น้า จ้ะ",
        kept_patterns=(r"^(?:5|๕){2,}$",),
        patterns=("ๆ", r"([\u0E00-\u0E7F])\1{2,}", r"^(?=.*[\u0E00-\u0E7F]).*(?:มั้ย|หรอ|ก้|ก้อ|เปน|จิง|โครต|แท๊ก|คอน|เว็บ|โพส|แอพ|ทวิต|ไร)$"),
    ),
    "tr": Rules(
        words="bide bende sende bizde sizde yada suan bisey bişey hersey herşey yokmu varmi varmı naber nolur napıyon napiyon geliyonmu gidiyonmu"
        " bi cnm tmm slm nbr kib amk aq mk yaaa yaa valla inş ins mrb cok degil guzel nasil icin hic boyle artik sey allahın allahim",
        exact="mi mı mu mü de da ki ne bu o a e i ı İ t k ben sen allah Allah Allahım",
        patterns=(
            r"(?i)^(?!.*[çğıöşüÇĞİÖŞÜ]).*(?:cok|degil|guzel|nasil|icin|hic|boyle|artik|baska|insallah|canim|ask|sey|suan)",
            r"^[bcçdfgğhjklmnprsştvyzBCÇDFGĞHJKLMNPRSŞTVYZ]{3,8}$",
            r"(?i)(?:iyom|iyon|iyosun|iyo|iyolar|cem|cam|caz|cez|yom|yon|yolar|miyon|miyom|musun|müsün|dicem|ıcam|icem|ucam|ücem)$",
            r"(.)\1{2,}",
            r"^[A-ZÇĞİÖŞÜ][A-Za-zÇĞİÖŞÜçğıöşü]+(?:da|de|dan|den|ta|te|tan|ten|ya|ye|a|e|ı|i|u|ü|nın|nin|nun|nün|ın|in|un|ün)$",
            "[$ßµ]",
        ),
    ),
    "ja": Rules(
        exact="てる でる じゃ じゃなくて ちゃっ ちゃう なきゃ んで っていう やっぱ やっぱり ぐらい ばっか ばっかり どっか あんまり ホント ほんとに スマホ バイト ネット"
        " リプ ググっ ワロタ コロナ ついった twitter RT DM TL LV M1 facebook amazon paypay zoom pixiv bgm",
        kept="て って ん 、 。 … 〜 ～ ！ ? ？ ー ｗ w www ね よ た か な だ や わ で に の と し さ が を も です ます いる ください WWW 笑 草 orz",
        kept_patterns=("^https?://", r"^www\.", r"^@\w+", "^#", "^[0-9０-９]+$", "^[_＿]+$"),
        patterns=(
            "[ｦ-ﾟ]", "[ぁ-ん][ァ-ン]|[ァ-ン][ぁ-ん]", "^(?=.*[A-Za-zａ-ｚＡ-Ｚ])(?=.*[ぁ-んァ-ン一-龯々〆ヵヶ])",
            r"[ー〜～]{2,}|[!！?？]{2,}|ｗ{2,}|w{2,}", r"(.)\1{3,}", "(?:てる|でる|じゃん|じゃ|っす|ちゃう|ちゃっ|なきゃ|んで|っていう|って)$",
        ),
        protect=False,
    ),
}
_KO_REACTION = "(?:[ㅋㅎ]+|[ㅠㅜ]+|ㅇㅇ|ㄴㄴ|ㄷㄷ|ㄱㄱ|ㅊㅋ|ㄱㅅ|ㅇㅋ|ㅇㄷ|ㅁㅊ|ㅉㅉ|ㅍㅌㅊ)"
RULES |= {
    "ko": Rules(
        exact="ㄹㅇ ㅇㄱㄹㅇ ㅅㅂ ㅆㅂ ㅆ1발 시발 씨발 Tlqkf ㅈㄴ 존나 좆나 존1나 걍 한녀 한남 짱깨 조센징 조센 병신 병신들 새끼들 새끼 놈 중딩 초딩 고딩"
        " 커엽 노잼 비추 존잘 개웃기네 킹치만 개 씹 좆 틀딱 갓본 년 노 누 긔 임 함 듯 듯요 이새끼",
        kept="ㅋㅋ ㅋㅋㅋ ㅋㅋㅋㅋ ㅋ ㅎㅎ ㅎㅎㅎ ㅎ ㅠㅠ ㅠㅠㅠ ㅠ ㅜㅜ ㅜㅜㅜ ㅜ ㅇㅇ ㄴㄴ ㄷㄷ ㄱㄱ ㅊㅋ ㄱㅅ ㅇㅋ ㅇㄷ ㅁㅊ ㅉㅉ 흠 음 아 어 헐 ... … !! !? ? ~ ㅡㅡ ^^ ^_^",
        patterns=(
            "시발|씨발|ㅅㅂ|ㅆㅂ|존나|좆나|ㅈㄴ|병신|새끼|놈|년|틀딱|짱깨|조센|한녀|한남|개씹|개쩔|개꼴|노잼|존잘|커엽|킹치|ㅇㅈㄹ|이지랄|쌉가능|개소리",
            rf"^(?!{_KO_REACTION}$)(?=.{{1,10}}$).*[ㄱ-ㅎㅏ-ㅣ]",
            "(?=.*[가-힣ㄱ-ㅎㅏ-ㅣ])(?=.*[A-Za-z0-9])",
            r"^(?:Tlqkf|tlqkf|qt|qk|wlsWk|Rk|rk|Rkwl|qkqh|whs나|[A-Za-z0-9^]+ㅣ발)$",
            rf"^(?!{_KO_REACTION}$).*([가-힣ㄱ-ㅎㅏ-ㅣ])\1{{2,}}",
            "^(?=.{3,}$).*(?:용|여|당|넹|구용|구여|군용|군여|나용|나여|네용|네여|세용|세여|합니당|입니당|답니당|랍니당)$",
        ),
    ),
}
_SLAVIC = Rules(
    kept="lol LOL haha hahaha hehe ahah xD XD",
    patterns=(REPEATED, r"^[A-Za-zÀ-ž]+['’]$", r"^(?=.{2,14}$)(?=.*(?:[cszCSZ]|dj|DJ|Dj))[A-Za-zÀ-ž][A-Za-zÀ-ž'’.-]*$"),
)
RULES |= {
    "sr": replace(_SLAVIC, words="sto sta vise nesto cu ce jos zasto nece moze necu bas kaze znaci jbg jbt aj al kuci zivot skole kauc decka mrs dovidjenja budzet ko bi jel l' k'o"),
    "hr": replace(
        _SLAVIC,
        words="sto sta šta cu ce jos vise al ak di kak tak san uvik gledat smislit pofotkat moš nes neš isprid cili posudit neko kauc noz tviteras fešn"
        " fejsbuk ko bi jel dal kaj",
    ),
    "sl": replace(
        _SLAVIC,
        words="sm tud blo sej jst js al tko mal zdej tut mam kej dobr ce pr lahk nč zarad dons vec sreco motis druzbeno skodo javla k sam ma neki",
    ),
    "iden": replace(RULES["id"], short="i'm im it's its dont don't you're youre gonna wanna"),
    "trde": replace(
        RULES["tr"],
        words=RULES["tr"].words.split(" cok degil")[0] + " ich hab nich ma schule theorie ethik deutsch deutsche deutschen almanca deutschland berlin semester uni",
        short="ne i de da oda party u foto bende sende das universität bahn sprache",
        exact="",
    ),
}
#: Japanese tokens that are candidates at a sentence's end only, and what may follow there; a Thai word that isn't one before a protected token.
JA_FINAL = ["ね", "よ", "た", "か", "です", "ます", "…", "〜", "～", "！", "。"]
JA_CLOSERS = ["", "。", "！", "!", "?", "？", "…", "〜", "～"]
TH_BEFORE_PROTECTED = "ชั้น"


def _compatible() -> str:
    """A character class of what compatibility normalisation changes, as ranges, from the Unicode data itself."""
    out, start, last = [], None, -2
    for k in [*(k for k in range(0x80, 0x10000) if unicodedata.normalize("NFKC", chr(k)) != chr(k) and not 0xD800 <= k < 0xE000), 0x10FFFF]:
        if k != last + 1:
            if start is not None:
                out.append(rf"\x{{{start:X}}}-\x{{{last:X}}}")
            start = k
        last = k
    return "[" + "".join(out) + "]"


#: A token in Japanese script whose width or form compatibility normalisation changes.
JA_WIDTH = r"^(?=.*[ぁ-んァ-ン一-龯々〆ヵヶ]).*(?:" + _compatible() + r"|[ぁ-んァ-ン][\x{3099}\x{309A}])"
RULES["ja"] = replace(RULES["ja"], patterns=(*RULES["ja"].patterns, JA_WIDTH))


def is_final(raw: str = "raw", at: str = "tok_idx") -> Column:
    """If only closing marks follow a position of a sentence's array."""
    rest = F.slice(F.col(raw), F.col(at) + 2, F.size(raw))
    return F.forall(rest, lambda t: t.isin(JA_CLOSERS))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(rx(p))
    return out


def rule(rules: Rules, tok: str = "raw") -> Column:
    s = strip(F.col(tok))
    low = F.lower(s)
    hit = low.isin(rules.words.split() + rules.short.split()) | s.isin(rules.exact.split()) | _any(s, rules.patterns) | _any(low, rules.low_patterns)
    ending, unless = rules.endings_unless
    if ending:
        hit = hit | (s.rlike(rx(ending)) & ~s.rlike(rx(unless)))
    kept = (s.isin(rules.kept.split()) & ~s.isin(rules.exact.split())) | _any(s, rules.kept_patterns) | (s == "")
    free = ~strong_protect(s) if rules.protect else F.lit(True)
    if rules.allowed:
        free = free | s.isin(list(rules.allowed))
    return free & ~kept & hit


def is_candidate(tok: str = "raw", lang: str = "lang", following: str | None = None, final: Column | None = None) -> Column:
    """If a token is a candidate in its language; languages without rules have none.

    ``following`` names the next token's column and ``final`` tells if only
    closing marks follow; without them the rules that look ahead stay silent.
    A column named ``code`` is taken as a code in its usual form.
    """
    code, out = lang_code(F.col(lang)) if lang != "code" else F.col(lang), F.lit(False)
    for name, rules in RULES.items():
        one = rule(rules, tok)
        if name == "ja" and final is not None:
            one = one | (F.col(tok).isin(JA_FINAL) & final)
        if name == "th" and following:
            one = one & ~((F.col(tok) == TH_BEFORE_PROTECTED) & strong_protect(F.col(following)))
        out = F.when(code == name, one).otherwise(out)
    return F.coalesce(out, F.lit(False))


def spans(candidates: str = "candidate", most: int = 3) -> Column:
    """Half-open spans ``start-end`` around the candidate positions of an array of flags: up to ``most`` tokens, from one before a candidate."""
    n = F.size(candidates)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.get(candidates, i), F.lit(False)))
    around = F.flatten(
        F.transform(
            at,
            lambda i: F.flatten(
                F.transform(
                    F.sequence(F.greatest(i - 1, F.lit(0)), i),
                    lambda s: F.transform(F.sequence(i + 1, F.least(n, i + most)), lambda e: F.struct(s.alias("start"), e.alias("end"))),
                )
            ),
        )
    )
    return F.array_sort(F.array_distinct(F.filter(around, lambda x: x.end - x.start <= most)))
