"""Word lists that results depend on.

Fixed values: each list below holds values that must be these for right results.
"""

from __future__ import annotations

# English function words with their Vietnamese, by category. Empty: not translated.
_FUNCTION_WORDS = """
[ARTICLE]
a =
an =
the =
[PRONOUN]
i = tôi
you = bạn
he = anh ấy
she = cô ấy
it = nó
we = chúng tôi
they = họ
me = tôi
him = anh ấy
us = chúng tôi
them = họ
myself = chính tôi
himself = chính anh ấy
herself = chính cô ấy
themselves = chính họ
itself = chính nó
who = ai
whom = ai
what = gì
everyone = mọi người
everybody = mọi người
everything = mọi thứ
someone = ai đó
somebody = ai đó
something = cái gì đó
nobody = không ai
nothing = không gì
[POSSESSIVE]
my = của tôi
your = của bạn
his = của anh ấy
her = của cô ấy
its = của nó
our = của chúng tôi
their = của họ
whose = của ai
[DEMONSTRATIVE]
this = này
that = đó
these = này
those = đó
[QUANTIFIER]
some = một số
any = bất kỳ
all = tất cả
both = cả hai
each = mỗi
every = mọi
many = nhiều
much = nhiều
few = ít
little = ít
several = vài
other = khác
another = một cái khác
such = như vậy
one = một
two = hai
three = ba
four = bốn
five = năm
six = sáu
seven = bảy
eight = tám
nine = chín
ten = mười
eleven = mười một
twelve = mười hai
twenty = hai mươi
thirty = ba mươi
forty = bốn mươi
fifty = năm mươi
hundred = trăm
thousand = nghìn
million = triệu
billion = tỷ
[BE]
am = là
is = là
are = là
was = là
were = là
be = là
been = là
being = là
[HAVE]
have = đã
has = đã
had = đã
[DO]
do =
does =
did =
[MODAL]
can = có thể
could = có thể
may = có thể
might = có thể
must = phải
should = nên
ought = nên
need = cần
[FUTURE]
will = sẽ
shall = sẽ
would = sẽ
[NEGATION]
not = không
n't = không
no = không
never = không bao giờ
cannot = không thể
[PREPOSITION]
of = của
in = trong
on = trên
at = tại
to = đến
for = cho
with = với
from = từ
by = bởi
about = về
into = vào
onto = lên
over = trên
under = dưới
above = phía trên
below = phía dưới
between = giữa
among = trong số
through = qua
during = trong suốt
including = gồm cả
excluding = không tính
regarding = về
concerning = về
considering = xét đến
depending on = tuỳ theo
without = không có
against = chống lại
towards = về phía
toward = về phía
upon = trên
within = trong vòng
across = băng qua
around = quanh
near = gần
off = khỏi
out = ra
up = lên
down = xuống
[CONJUNCTION]
and = và
or = hoặc
but = nhưng
because = bởi vì
if = nếu
unless = trừ khi
when = khi
while = trong khi
since = kể từ khi
until = cho đến khi
although = mặc dù
though = mặc dù
however = tuy nhiên
therefore = do đó
so = nên
than = hơn
as = như
whether = liệu
where = nơi
why = tại sao
how = như thế nào
which = cái nào
[ADVERB]
very = rất
too = quá
also = cũng
only = chỉ
just = chỉ
still = vẫn
already = đã
yet = chưa
now = bây giờ
then = sau đó
always = luôn luôn
often = thường
sometimes = đôi khi
usually = thường
again = lại
here = ở đây
more = hơn
most = nhất
well = tốt
soon = sớm
today = hôm nay
yesterday = hôm qua
tomorrow = ngày mai
[EXISTENTIAL]
there = có
"""

# Irregular forms, after the lemma they belong to.
_IRREGULAR = """
be: was were been am is are
have: had has
do: did does done
go: went gone goes
make: made
say: said
take: took taken
come: came
give: gave given
get: got gotten
see: saw seen
know: knew known
think: thought
bring: brought
buy: bought
catch: caught
teach: taught
fight: fought
seek: sought
find: found
feel: felt
keep: kept
leave: left
lose: lost
mean: meant
meet: met
pay: paid
put: put
read: read
run: ran run
sit: sat
send: sent
sleep: slept
sell: sold
spend: spent
stand: stood
tell: told
understand: understood
win: won
write: wrote written
speak: spoke spoken
break: broke broken
choose: chose chosen
drive: drove driven
eat: ate eaten
fall: fell fallen
fly: flew flown
forget: forgot forgotten
grow: grew grown
hold: held
hear: heard
hide: hid hidden
hit: hit
hurt: hurt
lead: led
lie: lay lain
ride: rode ridden
rise: rose risen
sing: sang sung
shake: shook shaken
shoot: shot
show: shown
shut: shut
sink: sank sunk
steal: stole stolen
strike: struck
swim: swam swum
throw: threw thrown
wake: woke woken
wear: wore worn
build: built
burn: burnt
deal: dealt
dig: dug
drink: drank drunk
feed: fed
flee: fled
freeze: froze frozen
hang: hung
kneel: knelt
lend: lent
light: lit
ring: rang rung
shine: shone
slide: slid
spread: spread
stick: stuck
sweep: swept
swear: swore sworn
weep: wept
wind: wound
man: men
woman: women
child: children
person: people
mouse: mice
goose: geese
foot: feet
tooth: teeth
louse: lice
ox: oxen
knife: knives
wife: wives
life: lives
leaf: leaves
half: halves
wolf: wolves
shelf: shelves
thief: thieves
loaf: loaves
self: selves
datum: data
medium: media
criterion: criteria
phenomenon: phenomena
analysis: analyses
basis: bases
crisis: crises
thesis: theses
index: indices
matrix: matrices
appendix: appendices
vertex: vertices
good: better best
bad: worse worst
much: more most
little: less least
far: farther farthest further furthest
old: elder eldest
"""

# Irregular past forms.
_PAST = """
was were been had did done went gone made said took taken came gave given got gotten saw seen knew known
thought brought bought caught taught fought sought found felt kept left lost meant met paid ran sat sent slept
sold spent stood told understood won wrote written spoke spoken broke broken chose chosen drove driven ate
eaten fell fallen flew flown forgot forgotten grew grown held heard hid hidden led lain rode ridden rose risen
sang sung shook shaken shot shown sank sunk stole stolen struck swam swum threw thrown woke woken wore worn
built burnt dealt dug drank drunk fed fled froze frozen hung knelt lent lit rang rung shone slid stuck swept
swore sworn wept
"""

# Abbreviations whose full stop doesn't end a sentence.
_ABBREVIATIONS = """
mr mrs ms dr prof sr jr st vs etc e.g i.e no inc ltd co corp fig approx mt u.s u.k a.m p.m ph.d cf al
"""

# Words that never end a phrasal match.
_OBJECT_PRONOUNS = "me you him her us them it my your his its our their"

# Letters that only Vietnamese text has.
VIETNAMESE_LETTERS = "ăâđêôơưạảãấầẩẫậắằẳẵặẹẻẽếềểễệịỉĩọỏõốồổỗộớờởỡợụủũứừửữựỵỷỹỳ"


def _function_words() -> dict[str, tuple[str, str]]:
    out, category = {}, ""
    for line in _FUNCTION_WORDS.strip().splitlines():
        if line.startswith("["):
            category = line.strip("[]")
        else:
            word, _, vi = line.partition(" =")
            out[word] = (vi.strip(), category)
    return out


FUNCTION_WORDS: dict[str, tuple[str, str]] = _function_words()
IRREGULAR: dict[str, str] = {form: lemma for line in _IRREGULAR.strip().splitlines() for lemma, _, forms in [line.partition(": ")] for form in forms.split()}
PAST_FORMS = frozenset(_PAST.split())
ABBREVIATIONS = frozenset(_ABBREVIATIONS.split())
OBJECT_PRONOUNS = frozenset(_OBJECT_PRONOUNS.split())
