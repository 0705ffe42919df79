"""Reference data: signs with ASCII stand-ins, US states, address and name tokens.

Kept as compact text and expanded on import.
"""

from __future__ import annotations

__all__ = """
DEFAULT_CREDENTIALS DEFAULT_DIRECTIONAL_MAP DEFAULT_MISSING_SENTINELS DEFAULT_NAME_PREFIXES
DEFAULT_NAME_SUFFIXES DEFAULT_PLACEHOLDER_SENTINELS DEFAULT_SPLIT_DELIMITERS
DEFAULT_STREET_SUFFIX_MAP DEFAULT_UNIT_MARKER_MAP
""".split()


def _signs(table: str) -> dict[str, str]:
    """Lines of a stand-in and the code points that it replaces; ``-`` spans a range, ``~`` is nothing, ``_`` a space."""
    out: dict[str, str] = {}
    for line in table.strip().splitlines():
        to, *points = line.split()
        to = {"~": "", "_": " ", "tilde": "~"}.get(to, to)
        for p in points:
            low, _, high = p.partition("-")
            for code in range(int(low, 16), int(high or low, 16) + 1):
                if chr(code) in out:
                    raise AssertionError(f"{code:04x} is listed twice")
                out[chr(code)] = to
    return out


ASCII_STAND_INS = _signs("""
- 2010-2015 2212 207b 208b fe63 ff0d 2022 2023 2027 2043
~ ad 34f 61c 115f 1160 17b4 17b5 180e 200b-200f 202a-202e 2060 2066-206f feff
_ 9 a d a0 2000-200a 2028 2029 202f 205f 3000 b7
~ 24 a2-a5 20a1 20a6 20a9-20ac 20b1 20b4 20b5 20b8-20ba 20bd 2030 2031
' 2018-201b 2032 2035 2039 203a
" 201c-201f 2033 2036 ab bb
''' 2034 2037
/ f7 2044 2215
x d7 2e3
. 2024 2219
.. 2025
... 2026
~ a7 a9 ae b0 b6 2da 2020 2021 204b-204d 2120 2122 221e
+- b1
tilde 2053 2248
!= 2260
<= 2264
>= 2265
! ac
a aa
o ba 2218
s 2e2
| a6
* 203b
!! 203c
?! 203d 2048
?? 2047
!? 2049
% 2052
""")

_STATES = dict(
    entry.strip().split(" ", 1)
    for entry in """
AK alaska; AL alabama; AR arkansas; AS american samoa; AZ arizona; CA california; CO colorado; CT connecticut;
DC district of columbia; DE delaware; FL florida; GA georgia; GU guam; HI hawaii; IA iowa; ID idaho; IL illinois;
IN indiana; KS kansas; KY kentucky; LA louisiana; MA massachusetts; MD maryland; ME maine; MI michigan;
MN minnesota; MO missouri; MP northern mariana islands; MS mississippi; MT montana; NC north carolina;
ND north dakota; NE nebraska; NH new hampshire; NJ new jersey; NM new mexico; NV nevada; NY new york; OH ohio;
OK oklahoma; OR oregon; PA pennsylvania; PR puerto rico; RI rhode island; SC south carolina; SD south dakota;
TN tennessee; TX texas; UT utah; VA virginia; VI virgin islands; VT vermont; WA washington; WI wisconsin;
WV west virginia; WY wyoming""".split(";")
)
_STATE_SHORT_FORMS = """
AL: ala/AR: ark/AZ: ariz/CA: cal, calif/CO: colo/CT: conn/DC: d c/DE: del/FL: fla/IL: ill/IN: ind/KS: kan, kans/
MA: mass/MI: mich/MN: minn/MS: miss/MT: mont/NE: neb, nebr/NV: nev/OK: okla/OR: ore, oreg/PA: penn, penna/
TN: tenn/TX: tex/VI: usvi, us virgin islands/WA: wash/WI: wis, wisc/WV: wva, w va/WY: wyo"""
#: Every recognised key (small letters, no periods) to the postal code.
STATE_CODES: dict[str, str] = {key: code for code, name in _STATES.items() for key in (name, code.lower())}
for _entry in _STATE_SHORT_FORMS.split("/"):
    _code, _, _forms = _entry.strip().partition(": ")
    STATE_CODES |= {form.strip(): _code for form in _forms.split(",")}
STATE_NAMES: dict[str, str] = {key: _STATES[code] for key, code in STATE_CODES.items()}
#: Codes that may trail a city; DC is part of a city's name.
TRAILING_CODES = tuple(sorted(code.lower() for code in _STATES if code != "DC"))


def _variants(table: str) -> dict[str, tuple[str, ...]]:
    """Entries of variants, ``=`` and what they become, in the order in which they are applied."""
    out = {}
    for entry in table.split(";"):
        words, _, to = entry.partition("=")
        out[to.strip()] = tuple(words.split())
    return out


DEFAULT_DIRECTIONAL_MAP = _variants(
    "n north = N; s south = S; e east = E; w west = W; ne northeast = NE; nw northwest = NW; se southeast = SE; sw southwest = SW"
)
DEFAULT_UNIT_MARKER_MAP = _variants(
    "apt apartment = APT; ste suite = STE; unit = UNIT; bldg building = BLDG; fl floor = FL; rm room = RM; dept department = DEPT;"
    "ofc office = OFC; spc space = SPC; lot = LOT; trlr trailer = TRLR; stop = STOP"
)
DEFAULT_STREET_SUFFIX_MAP = _variants(
    "st str strt street = ST; av ave aven avenu avenue = AVE; blvd boul boulv boulevard = BLVD; rd road = RD; dr drv driv drive = DR;"
    "ln lane = LN; ct crt court = CT; cir circ circl circle = CIR; pl place = PL; wy way = WAY; ter terr terrace = TER;"
    "pkwy pkway parkwy parkway = PKWY; trl trails trail = TRL; hwy hway hiwy hiway highway = HWY; loops loop = LOOP;"
    "sq sqr sqre square = SQ; plz plza plaza = PLZ; pt point = PT; aly ally allee alley = ALY; bnd bend = BND;"
    "xing crssng crossing = XING; holw hollows hollow = HOLW; pass = PASS; paths path = PATH; pikes pike = PIKE; run = RUN;"
    "row = ROW; walks walk = WALK; grv grov grove = GRV; hts heights = HTS; mnr manor = MNR; mdws mdw meadows = MDWS;"
    "rdg rdge ridge = RDG; spg spng spring = SPG; spgs spngs springs = SPGS; vlg villg vill village = VLG; vw view = VW;"
    "expy express expr expressway = EXPY; fwy frwy freeway = FWY; ctr cntr centre centr cent center = CTR; gdn garden = GDN;"
    "gdns gardens = GDNS; cres crsent crescent = CRES; cv cove = CV; est estate = EST; cyn cnyn canyn canyon = CYN; lk lake = LK;"
    "crk creek = CRK; fls falls = FLS; jct jction junction = JCT; mt mount = MT; mtn mntn mtin mountain = MTN;"
    "tpke turnpike = TPKE; vly vlly valley = VLY"
)
DEFAULT_NAME_SUFFIXES = tuple("esq ii iii iv jnr jr snr sr".split())
DEFAULT_NAME_PREFIXES = tuple("capt dame dr hon miss mr mrs ms mx prof rev sir".split())
DEFAULT_CREDENTIALS = tuple(
    "cfa cfp cma cpa crna dds dmd dpm dsc dvm edd faap facc facp facs jd lcsw llm lmft lpc lpn mba md mph msw np pe pharmd phd pmp psyd"
    " rdn rn scd".split()
)
DEFAULT_MISSING_SENTINELS = frozenset({"", *"NA N/A NAN NONE NULL".split()})
DEFAULT_PLACEHOLDER_SENTINELS = frozenset("?")
DEFAULT_SPLIT_DELIMITERS = tuple(",;|/-")
