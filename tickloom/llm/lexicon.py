"""Word lists of the screening for abusive, hateful and sexual texts: general terms, none of them taken from a table.

All words are given in folded form: lower case, no accents, ss for sharp s.
"""

# Words by the part they play. English, German, Spanish, French, Korean (by stem).
WORDS = {
    "insult": """idiot idiots moron morons imbecile imbeciles cretin cretins retard retards asshole assholes arsehole bastard bastards
        bitch bitches scumbag scumbags dickhead dickheads loser losers parasite parasites clown clowns dumbass jackass
        motherfucker prick cunt wanker twat whore slut pig scum trash dimwit halfwit fool coward freak
        trottel vollidiot idioten wichser versager drecksack arschloch penner schlampe hurensohn missgeburt blodmann dummkopf
        parasit cabron gilipollas imbecil idiota payaso parasito inutil estupido cretino perra puta pendejo
        schwein mistkerl drecksau miststuck spast spasti blodian arschgeige schwachkopf schwachsinniger dreckskerl
        tonto subnormal cerdo asqueroso maricon zorra cabrona mamon bobo estupida tarado
        encule debile pouffiasse ducon tocard petasse crevure
        abruti connard connasse cretin salope salaud ordure batard pute bouffon""",
    "adjective": """spineless worthless pathetic useless filthy disgusting slimy brainless lazy dumb stupid ugly rotten miserable
        dummer dreckiger nutzloser erbarmlicher blode dumme elender fauler
        sucio asqueroso maldito vago sale stupide minable inutile""",
    "you": """you your yours yourself u ur du dich dir dein deine deiner tu te toi ton ta tes ti tus eres vous vos votre usted
        ihr euch""",
    "group": """women woman girls gays gay lesbians foreigners immigrants migrants refugees muslims jews christians blacks asians
        disabled cripples elderly natives faith folk folks tribe race breed
        frauen auslander schwule juden behinderte fluchtlinge
        mujeres extranjeros inmigrantes gais judios negros
        femmes etrangers immigres juifs noirs""",
    "dehuman": """vermin rats roaches cockroaches subhuman subhumans animals scum plague filth parasites savages stink infest
        ungeziefer abschaum pack ratten stinkt stinken untermenschen plaga escoria ratas basura bestias
        vermine racaille cafards pourriture""",
    "sexual": """blowjob handjob pussy cock cocks tits boobs nudes horny cum dildo porn orgasm
        nacktbilder nacktfotos geil titten ficken muschi schwanz follarte follar tetas cono desnuda polla
        baiser nichons bite chatte""",
    "violence": """kill killing murder stab shoot strangle choke hurt beat punch slap smash burn hang rape butcher slaughter behead drown skin destroy cripple
        toten umbringen erschiessen schlagen verprugeln erwurgen abstechen erstechen verbrennen zusammenschlagen matar matare pegar golpear apunalar quemar ahorcar
        estrangular romper reventar tuer tuerai frapper etrangler poignarder bruler pendre egorger crever casser""",
    "harm": """break cut crush rip slit bash snap gut knock brechen zerschlagen einschlagen partir rajar briser exploser""",
    "body": """bones neck throat finger fingers face skull teeth kneecaps knees legs arms head jaw guts ribs nose knochen hals zahne fresse schadel finger
        huesos cuello garganta cara dientes cabeza piernas os cou gorge dents tete jambes doigts""",
    "suffer": """die bleed burn rot drown suffocate choke perish sterben verrecken verbluten bluten morir mueras morirte sangrar crever mourir creves""",
    "first": """i we ill well someone somebody ich wir jemand yo nosotros alguien je nous quelquun voy vamos""",
    "modal": """will gonna going should must shall want werde werden wurde will sollte voy vamos vais allons deberia va vas quiero veux""",
    "eradicate": """exterminated gassed deported eradicated sterilized castrated lynched euthanized shot hanged vergast ausgerottet abgeschoben deportiert
        exterminados gaseados deportados expulsados extermines gazes deportes expulses""",
    "despise": """hate despise loathe hasse verachte odio desprecio deteste hais meprise""",
    "sexact": """fuck fucking lick licking suck sucking spank grope fondle caress undress masturbate masturbating penetrate moan moaning lecken lutschen blasen
        lamer chupar lecher sucer caresser""",
    "sexpart": """ass dick cock tits boobs breasts nipples pussy crotch thighs butt panties penis vagina arsch schwanz titten muschi bruste culo polla tetas pezones bite chatte seins fesses""",
    "dwelling": """live lives sleep park house home car kids family children wohnst wohnt schlafst parkst auto haus kinder familie
        vives duermes aparcas casa coche hijos familia habites habitez dors gares maison voiture enfants famille""",
    "mention": """policy forbids forbidden moderation banned insulted harassment insult insults slur slurs verboten prohibido interdit""",
}

# Verbs of saying, after which another's words are reported.
REPORTING = """said says saying called calls calling wrote writes writing written named naming quoted quotes quoting reported reports
    nannte nennt genannt nennen schrieb schreibt sagte dijo dice escribio llamo llamar llamado appele appeler traite ecrit disait"""

# Verbs that say what several are, words that may stand between them and the term, and subjects of which no term demeans a group.
COPULAS = "are were sind waren son eran sont etaient"
BETWEEN = """a the all just only nothing but simply really such like worse than human fucking absolute complete pure total always still
    ein eine alle nur wie einfach doch reines reine una un unas unos la el los las pura solo todos todas como de des du que tous toutes rien"""
SUBJECTLESS = """there these those this that which what who where it we i you some most many few both here da das was wer wir ihr es hay estos estas
    esto eso ellas que nous vous ce ces ceux cest"""
NONHUMAN = """rat rats mouse mice roach roaches cockroach cockroaches insects insect ants flies mosquitoes wasps moths beetles bugs bug ticks mites fleas
    lice worms leeches fungi bacteria viruses birds pigeons dogs cats pigs cows horses wolves foxes rabbits rodents pests animals species weeds
    mammals whales
    tests test logs log alerts alarms builds errors queries tickets meetings merges locks threads processes jobs caches tables rows columns
    values data readings events timestamps nulls duplicates files scripts configs macros globals singletons pointers hacks defaults warnings
    outages retries timeouts cables sensors machines robots lines filters floors walls parts boards dependencies frameworks comments names
    emails mails notifications flags results numbers leftovers
    ratten mause insekten fliegen kafer wanzen zecken milben flohe wurmer tauben hunde katzen tiere schadlinge daten tabellen fehler zeilen werte
    tests dateien logs meldungen
    ratas ratones insectos moscas cucarachas palomas perros gatos animales datos tablas errores filas valores pruebas archivos alertas
    rats souris insectes mouches cafards pigeons chiens chats animaux donnees tables erreurs lignes valeurs fichiers alertes"""

# Harmless words close to listed ones, so that a misspelling isn't taken for the wrong word.
HARMLESS = """batch batches clock clocks clocked slot slots slut's where whose were rate rates rat rows pick brick pitch bench beach
    match patch watch catch fetch idiom idioms marron passive paradise losses loses closer closed clow crown clone claims clean flow
    total pig's peg big trick price print prism public put puts punt pure page pages pack packs package block blocks lock locks rock
    sock dock docks cork cook clerk node nodes notes dudes modes units tips tabs tips ties bits hits sits bats boots books bonus
    common women's lesson worker shore where's gate gates gray guy grey day way pay ray parse parasitic passed faster festers
    racer rice face pace trace grace brace ranks ramps raps rafts ratio maps mats cats hats data date dates late lane line linen
    scan scam slim slimmed lasts lazily dump dumps thumb crumb duly durch dies diese dieser dich's mich sich noch nicht dem den des
    dann denn geht gibt gilt dichte richtig die der das daten dauer teil teile toll tous tout toute tous-les cote cones como cons cada
    pare para pero sera seran sube tube tuve tipo todo toda muertas puerta puertas punto pulso pura palla pollo bit byte bites butte
    chute chaque quatre motte note suite site vite acte folder follower follow pusher fussy busy pushy passy porn's port ports born
    corn horn worn horns hornet corny honey come sum cup cut cue cure core curve custom dial dills fool's food foot pool tool tools
    cool stool fold cold told coward's toward forward freak's break wreck fresh friar loose looser user poser lower later laser
    certain retarded retry retries record regard reward postal pastel bistro master faster postard custard""".replace("'s", "")

# Common words of the five languages within the errors allowed of a listed one. They stand for themselves; unlike the
# harmless ones they aren't what a misspelling is corrected to.
COMMON = """able abort accidental acts addressed alles alone alter anker approaches ares around art backs baisse baisser banker banner batched batten
    beasts being belong bestia beta betas birch bitte bitten black blade blanks bleak bleed blender blobs blocker blogs blonde bloody boards bobs bode
    boden bogus book boost boot booth boron boss bound braces brash brauen bread breaks brian bribe brown buffon bumps bunch busted buttons bytes
    cable canards canned caps carbon cares caron cases casse cast casts catches char chars chart charte chat chatter chokes chore chose chown claim
    clark cleans clear clever click cloned clones close closes coaches codes collar collate comes cone controls cores crash crashed creak creed cron
    curves define definer deserve destroys dicken dimmer disable disables discussing ditch docker docs doing dollar done donne drain drains drink
    drummer dumm dummes dummy dumper each enabled envio envoie etranges expects faint fait fallar faller faule favor federation feine feiner ferme
    fermees fermes fifth filch filet filled fills fire fired fires first fixed fixing flicken flood folders follaje followed follows forbid forks form
    forwards found fourniture fournitures fours fragen freed galope gated gehindert gemmes getting gives gotten grade grauen grave greed grills ground
    hall halt handy hangs happens harm hatch hatten healthy hired hiring hitch hoes holder hooks hors hour hours hummer incidents infect ingest inset
    invest itch jedem jeden johan jordan judith kaiser kaisers kalender keine keiner kenner kitten kummer lacked lacks laisser lands last latas latex
    latten latter layer league lease leaves lender lessons lies linea liner lines lists lives lone looked looks loosen lose loss lots lover lucio
    machines macron march maroon matches mated math matten matter medios meine meiner mejores metas mille mineable mitten model models moins month
    moon mouse moves named natas native nenner netas newer nicken night nits noir noted notre nourriture nude nummer older olla omen ones operation
    ordre organ organism organs ours packaged packages pager painless paint pane paper paraiso parent parsed parser parses parts passes paste pasted
    patas patches patents path pause paused pera perla perro perry picken picks pieces pince piped pitches plan plane plans plants plaque plata playa
    player plaza poaches point poll polls pools pose posts pours power prices prime prints push pushed pushes quad queues quite races raiser ramas
    rank ranker raten ratos ravages reach reaches records recovery rectas reed regards renner reported respects retried reword rights ring ritten
    rocaille roman roots rotted route rusted rutas sake salad salvages schule schwarz score scrape sean seconds seine seiner sender setting shame
    shape shard shared shares sharp shifts short shot shouldn shows shrink sierra sink sinken sinkt sites slacks slash slime slink slope slower socio
    socks soirs sorts sound spaces span spans spark sparse sprint stable steam steel stick stitch store strangers stream stunk suites summe summer
    super tables tanker taught teach teal terminated terra there thin thing things think thorny thrash threw thrown throws tick ticken tile tired
    titel titeln torch totals touched touches tours towards traces track trade train trauen tricky trie trinken tripe trite trusted tweak unique unit
    unrest unset used ustedes verhinderte very vote walker wasted werden whole winken wired wiring wischer witch woken womens word worked workers
    world worst would wrapper written"""

# Idioms of several words, common in public speech, by what they are.
IDIOMS = {
    "insult": """
        fuck off, fuck you, fuck yourself, fuck u, piss off, screw you, go to hell, drop dead, go die, kill yourself, hang yourself, kys,
        piece of shit, pieces of shit, waste of oxygen, waste of space, waste of skin, shut the fuck up, shut your mouth, shut your trap, shut your face,
        kiss my ass, son of a bitch, sons of bitches, suck my dick, eat shit, full of shit and you know it, go hang yourself, nobody would miss you, nobody would even miss you, nobody will miss you,
        verpiss dich, halt die fresse, halt dein maul, halt die klappe, halt deine fresse, halts maul, fick dich, leck mich, stuck scheisse, scher dich zum teufel,
        vete a la mierda, que te jodan, que te den, vete al diablo, callate la boca, hijo de puta, hija de puta, pedazo de mierda, me cago en ti,
        va te faire foutre, va te faire voir, ferme ta gueule, fils de pute, nique ta mere, casse toi, tas de merde, va au diable""",
    "threat": """
        watch your back, i know where you live, i will find you, we will find you, you are dead, you are a dead man, you will regret this, you will pay for this,
        i will make you suffer, you will not see tomorrow, your days are numbered, pass bloss auf, ich weiss wo du wohnst, du bist tot, das wirst du bereuen, ich finde dich, ich bring dich um, ich bringe dich um, ich mach dich fertig, ich mache dich fertig, ich schlag dich tot, ich schlage dich tot,
        se donde vives, estas muerto, te vas a arrepentir, te voy a encontrar, je sais ou tu habites, tu es mort, tu vas le regretter, tu vas le payer, je vais te retrouver""",
    "sexual": """send nudes, send me nudes, send me your nudes, jerk off, jerking off, dick pic, dick pics, blow job, hand job, suck my cock""",
}
# Stems of Korean abuse, found within words.
KOREAN = {"insult": "병신 개새끼 씨발 시발놈 지랄 꺼져 닥쳐 미친놈 미친년", "threat": "죽여버 죽인다 죽여줄", "sexual": "야한사진 벗은사진"}

# Look-alikes of Latin letters, and signs written for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "в": "b", "к": "k", "м": "m",
    "н": "h", "т": "t", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u",
    "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i",
}
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "€": "e", "+": "t"}
