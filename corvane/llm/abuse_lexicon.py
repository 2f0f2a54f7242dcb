"""p8: the words the score looks at, by language and class. Accents are removed before matching.

Classes: I insult, W name of a thing or beast given to people, B debasing adjective, b a milder one, K dismissal, V violence,
F death and harm, E exclusion, S sexual act, s suggestive word, N body or nudity, J demand, Y you, y your, M me,
H they, P person, G group, p people, L quantifier, R should or will, h hope, C copula, A article or filler,
l like, n negation, Z what a, Q context of rules, care, training or technology, T thing, O with or for, k conjunction, x preposition and the like. A word may stand for two classes.
"""

from __future__ import annotations

LANGUAGES = ("en", "de", "fr", "es")

# Idioms, read as one word of the class.
IDIOMS = {
    "en": {
        "I": ["piece of (?:shit|crap|trash|garbage|filth|dirt|dung)", "waste of (?:skin|space|oxygen|air|breath)", "sons? of a bitch"],
        "K": ["shut (?:the \\w+ )?up", "shut your \\w+", "get lost", "(?:fuck|piss|sod|bugger) off", "(?:fuck|screw|damn) you", "go to hell", "rot in hell", "burn in hell", "drop dead", "(?:kill|hang|hurt) yourself",
              "watch your back", "know where you live", "up yours", "crawl back", "get out of my \\w+", "go back to (?:your|where)"],
        "F": ["not be alive", "not deserve to (?:live|breathe)", "run over by", "(?:get|gets|be|been) run over", "end up in a", "never wake up", "stop breathing", "six feet under"],
        "S": ["(?:sleep|sleeps|slept|bed|night) with(?= (?:me|him|her|us))", "bend (?:you|her|him) over", "lap dance", "have sex", "having sex", "had sex", "go to bed with", "get laid", "jerk off", "sexual favou?rs?"],
        "s": ["on (?:your|her|his) knees", "on my lap", "sit on my \\w+", "hotel room", "take off your \\w+", "spread your \\w+"],
        "E": ["thrown? out", "locked (?:up|away)", "kept (?:off|out|away)", "(?:not|never) be (?:hired|employed|allowed)", "go back", "wiped out", "sent (?:back|home|away)", "not belong", "get rid of", "no (?:wage|pay|rights)", "keep out"],
        "A": ["kind of", "sort of", "nothing but", "nothing more than", "bunch of", "bit of", "pack of"],
    },
    "de": {
        "I": ["stuck (?:dreck|scheisse|mull)"],
        "K": ["halt\\w* (?:die|deine|dein|das|s) (?:fresse|klappe|schnauze|maul|mund)", "verpiss dich", "fick dich", "leck mich", "hau ab", "geh sterben", "fahr zur holle", "zieh leine", "bring dich um", "pass auf dich auf", "scher dich"],
        "F": ["auf den mull", "nicht (?:verdient )?zu leben", "kein recht zu leben"],
        "E": ["nie\\w* eingestellt", "raus aus", "gehoren? (?:nicht|eingesperrt|abgeschoben|weg)", "nicht hierher", "nichts zu suchen"],
        "S": ["mit mir schlafen", "schlaf\\w* (?:sie )?mit mir", "ins bett mit", "blas mir", "mit mir ins bett"],
        "s": ["zieh\\w* (?:dich|sie sich|dein \\w+) aus", "auf die knie", "mein hotelzimmer"],
        "Z": ["was fur"],
    },
    "fr": {
        "I": ["(?:gros|grosse|sale|pauvre|petit|petite|espece de|quel|quelle) con(?:ne|nes|s)?", "fils de pute", "grosse merde", "tas de merde", "sac a merde"],
        "K": ["ta gueule", "(?:ferme|fermez|boucle) (?:la|ta|ton|votre)(?: \\w+)?", "va te faire \\w+", "allez vous faire \\w+", "nique ta \\w+", "casse toi", "cassez vous", "va au diable", "va en enfer", "degage", "va crever", "je sais ou tu habites"],
        "F": ["pas de vivre", "pas le droit de vivre", "creve\\w*"],
        "E": ["embauche\\w* jamais", "rentr\\w+ chez", "pas leur place", "mettre dehors", "dehors"],
        "S": ["couche\\w* avec (?:moi|lui|elle)", "suce\\w* (?:moi|la)", "au lit avec moi", "faire l amour"],
        "s": ["a poil", "deshabille\\w*", "ma chambre d hotel", "a genoux"],
        "A": ["de la", "qu un", "qu une"],
    },
    "es": {
        "I": ["hij[oa]s? de (?:puta|perra)", "pedazo de \\w+"],
        "K": ["vete a la \\w+", "vayan a la \\w+", "que te (?:jodan|den|follen)", "calla", "callate", "callaos", "callarse", "cierra (?:la|el|tu) \\w+", "largate", "larguense", "vete al (?:infierno|diablo)", "muerete", "se donde vives", "chupamela", "jodete"],
        "F": ["no merece\\w* vivir", "no mereces? la vida"],
        "E": ["no deben? (?:trabajar|entrar|estar|vivir)", "fuera de", "que se (?:vayan|larguen)", "echarlos"],
        "S": ["(?:acuestate|acuestas|acostarte|acostarse) conmigo", "a la cama conmigo", "sexo conmigo", "tener sexo", "hacer el amor"],
        "s": ["quitate la \\w+", "de rodillas", "mi habitacion", "mi hotel"],
    },
}

# Words by class. Regular inflections are added by `forms`.
WORDS = {
    "en": {
        "I": "idiot moron imbecile cretin asshole arsehole scumbag dickhead dumbass jackass wanker cunt motherfucker fucker shithead dipshit halfwit dimwit douchebag douche slut whore skank nitwit numbskull simpleton fuckface fuckwit bellend tosser twat bastard bitch retard prick pillock bimbo faggot nigger kike shitbag dumbfuck asshat nutjob lowlife cocksucker",
        "W": "loser pig swine trash garbage filth scum rat vermin cockroach parasite animal dog clown fool dunce leech snake worm maggot savage monkey ape thief thieves criminal disease plague cancer infection infestation pest subhuman turd weasel creep pervert liar coward freak hag cow toad slob tramp freeloader scrounger dirt disgrace ninny cockroaches ape locust beast terrorist",
        "B": "pathetic filthy stupid ugly disgusting worthless dumb useless vile repulsive brainless retarded inferior idiotic moronic stinking primitive degenerate miserable contemptible revolting hideous spineless gutless clueless mindless uncivilized evil goddamn fucking braindead trashy braindead",
        "b": "rotten lazy dirty fat nasty greedy smelly ignorant bloody bleeding",
        "V": "kill kills killed beat beats beaten hurt stab shoot shot strangle smash crush punch slap bash slaughter murder gut choke throttle rape behead hang cut skin torture poison break destroy slit",
        "F": "die dies dead bleed suffer rot burn perish ditch grave coffin morgue choke pay regret",
        "E": "deport deported deportation exterminate exterminated eradicate eradicated gassed sterilized expelled banned removed jailed shot eliminated lynched",
        "S": "fuck fucks screw screws shag shags grope gropes fondle spank blowjob handjob bang bangs undress lick suck sucks cum orgasm molest",
        "s": "body strip sexy kiss touch horny lingerie underwear naughty bed seduce thong erotic bra tight tonight",
        "N": "tits boobs pussy cock dick ass nude nudes naked penis vagina breasts nipples butt titties",
        "J": "send show give mail text let want wanna come bring flash sends shows",
        "Y": "you u ya thou yourself yourselves", "y": "your yer ur", "M": "i me my we us our im mine", "H": "he she him her they them his hers their those these",
        "P": "whoever someone somebody boss recruiter manager clerk colleague lead supervisor guy man woman girl boy director ceo secretary coworker teammate person intern candidate applicant interviewer customer neighbour driver teacher lady",
        "G": "immigrant foreigner refugee migrant women woman black jew muslim christian arab asian african gay lesbian homosexual disabled cripple gypsy gypsies roma elderly race outsider mexican indian chinese jewish blacks whites queer trans hindu polish turk romanian foreigners",
        "p": "seeker seekers fifty people folk lot crew ones tribe applicants guys bunch families workers candidates men everyone", "L": "all every those these each such any",
        "R": "should must ought deserve deserves will ll shall going gonna would wanna need needs", "h": "hope wish pray hopefully",
        "C": "are is re am was were be being s", "A": "a an the such just only so too born like complete total absolute utter real really little old big very always all nothing true damn another one by of nature",
        "l": "like", "n": "not never no nobody none dont don t cannot", "Z": "what", "O": "with for to on",
        "Q": "policy policies rule rules prohibit prohibits prohibited prohibition forbid forbids forbidden harass harassment prevent prevents prevention training workshop seminar report reports reporting reported moderate moderates moderation moderator moderators filter filters detect detects detection classify classifier screen screening education guideline guidelines conduct handbook tolerance complaint complaints victim victims survivor survivors counselling counsellor therapy clinic nurse nurses patient patients health court law definition term terms word words slur slurs label labels flag flags flagged slang language novel film history study studies research lab tolerate tolerated punish dismissed banned proof dataset support annotate annotated call called calls calling",
        "k": "and or but because", "x": "who that which in at if when than from after before",
        "T": "process processes deadline server servers task job jobs thread threads code bug bugs price prices product products software tool tools file files branch animal dog plant plants test tests system systems app machine machines data budget record records pipeline query target targets competitor competitors market",
    },
    "de": {
        "I": "idiot arschloch schwachkopf vollidiot dummkopf wichser miststuck hurensohn drecksau trottel dreckskerl missgeburt arschgeige blodmann vollpfosten scheisskerl depp volldepp spast fotze schlampe hure arsch wixer drecksack schweinehund kanake neger mistkerl flachzange penner scheissker",
        "W": "schwein schweine abschaum mull dreck ungeziefer ratte ratten versager parasit parasiten niete tiere tier diebe dieb verbrecher pest krankheit untermenschen untermensch schmarotzer seuche hund sau affe affen made maden zecke zecken loser luegner kakerlaken kakerlake kriminelle plage gesindel pack esel",
        "B": "dumm dumme dummer dummes minderwertig minderwertige blod blode bloder blodes hasslich hassliche ekelhaft ekelhafte widerlich widerliche widerlicher erbarmlich erbarmliche erbarmlicher elend elende elender nutzlos nutzlose nutzloser verdammt verdammte verdammter wertlos wertloser primitiv verblodet",
        "b": "dreckig dreckige dreckiger dreckiges faul faule fauler fett fette fettes stinkend stinkende",
        "V": "umbringen toten schlagen schlage totschlagen verprugeln erschiessen erschossen erwurgen abstechen zusammenschlagen verprugle umbringe bringe tote mach fertigmachen brechen vergewaltigen aufschlitzen umlegen verhauen",
        "F": "sterben stirb verrecke verrecken verreck krepieren krepier tot verbrennen grab leiden bluten bereuen bereust",
        "E": "abgeschoben abschieben ausgerottet vergast eingesperrt weggesperrt rausgeworfen raus vertrieben verboten ausgewiesen vernichtet",
        "S": "ficken fick ficke bumsen vogeln blasen lutschen lutsch poppen begrapschen sex",
        "s": "ausziehen nackig kuss kussen sexy geil heiss unterwasche bett streicheln beine hotelzimmer",
        "N": "titten muschi schwanz nackt nackte nacktbild nacktbilder nacktfoto nacktfotos arsch bruste busen",
        "J": "schick schicke schickst zeig zeige zeigst gib sende send lass komm will mochte",
        "Y": "du dich dir ihr euch", "y": "dein deine deinen deinem deiner euer eure", "M": "ich mir mich mein meine wir uns unser", "H": "er ihn ihm ihnen diese jene",
        "P": "chef chefin kollege kollegin recruiter vorgesetzter vorgesetzte mann frau typ kerl leiter leiterin bewerber",
        "G": "auslander auslanderin fremde fluchtlinge frauen juden muslime turken zigeuner behinderte schwule lesben schwarze asylanten migranten rasse polen araber fluchtling homosexuelle auslandern",
        "p": "leute menschen volk bande", "L": "alle diese solche jeder die", "R": "soll sollen solltest sollte sollten muss mussen musst gehoren gehort gehorst verdienen verdient verdienst werde wirst werden durfen darf", "h": "hoffe hoffentlich wunsche",
        "C": "bist seid sind ist war waren", "A": "ein eine einen einer eines so nur doch alle nichts als zu echt total wirklich richtig ganz von natur aus die der das ja wieder alles",
        "l": "wie", "n": "nicht nie niemals kein keine nichts", "Z": "welch welche", "O": "mit fur auf",
        "Q": "richtlinie richtlinien verbietet verboten belastigung seminar schulung regel regeln beratung labor filter moderation erkennt erkennung leitfaden pravention gericht gesetz begriff wort opfer klinik pflege patienten studie untersuchung untersuchen tierarzt",
        "k": "und oder aber weil", "x": "wenn in an bei vor nach",
        "T": "prozess server code projekt maschine software produkt termin labor",
    },
    "fr": {
        "I": "abruti abrutie connard connarde connasse salope salopard salaud encule cretin cretine debile enfoire petasse pouffiasse raclure imbecile idiot idiote batard trouduc putain pute tapette bougnoule bouffon branleur ordure",
        "W": "pourriture porc cochon chien chienne dechet vermine cafard nul nulle minable larve parasite rat voleur sauvage racaille animaux peste maladie truie rats merde nullite singe criminel cancer fleau nuisible betes ordures animal lache",
        "B": "stupide degueulasse bete laid laide moche inutile pitoyable repugnant repugnante inferieur ignoble degoutant minable",
        "b": "sale gros grosse paresseux puant puante feignant pauvre",
        "V": "tuer frapper casser egorger etrangler massacrer tabasser cogner battre defoncer violer poignarder bruler planter",
        "F": "crever creve mourir meurs meure bruler souffrir souffres mort regretter pourrir brules saigner",
        "E": "expulser expulses dehors virer renvoyer renvoyes enfermer enfermes exterminer extermines chasser embaucher embauchez gazer eliminer interdits",
        "S": "baiser baise niquer sucer suce lecher peloter coucher branler",
        "s": "deshabiller sexy embrasser string lit nuit caresser excite genoux culotte",
        "N": "seins nichons bite chatte cul nue nu nues nus fesses penis",
        "J": "envoie envoyez envoyer montre montrez donne laisse viens veux voudrais envoies",
        "Y": "tu te toi t vous", "y": "ton ta tes votre vos", "M": "je j moi me m mon ma mes nous", "H": "il elle ils elles lui leur eux",
        "P": "chef patron patronne collegue recruteur recruteuse directeur directrice mec type femme homme responsable",
        "G": "etrangers etranger immigres femmes juifs juif musulmans arabes noirs vieux handicapes homosexuels homos migrants roms refugies asiatiques race africains gays",
        "p": "gens mecs peuple", "L": "tous toutes ces les chaque", "R": "devrais devrait devraient devez dois doit doivent faut merites merite meritent vais va vas allez allons vont", "h": "espere souhaite",
        "C": "es est etes sont suis etait etaient etre", "A": "un une des de la le du qu trop vraiment si tellement espece vrai vraie petit petite pauvre sacre grand d l que tout tous",
        "l": "comme", "n": "pas jamais ne n aucun aucune rien", "Z": "quel quelle", "O": "avec pour",
        "Q": "charte interdit interdits harcelement formation reglement regle prevention signalement signaler victime victimes filtre moderation detecter terme mot loi tribunal soins clinique patients laboratoire atelier etude",
        "k": "et ou mais", "x": "qui parce si dans en chez apres avant",
        "T": "serveur serveurs processus projet code logiciel machine produit delai",
    },
    "es": {
        "I": "cabron cabrona imbecil pendejo pendeja gilipollas estupido estupida idiota malparido mamon maricon bastardo hijoputa zorra puta puto capullo subnormal mamarracho desgraciado desgraciada hijueputa culero pajero retrasado payaso",
        "W": "cerdo cerda basura escoria rata perra perro plaga inutil asqueroso asquerosa gusano parasito alimana animal peste criminal bicho enfermedad ladron ladrones delincuente mierda burro cucaracha cancer fracasado fracasada lacra animales salvaje",
        "B": "tonto tonta inferior asqueroso asquerosa patetico patetica maldito maldita puro pura apestoso repugnante ignorante miserable tontos inferiores despreciable",
        "b": "sucio sucia vago vaga feo fea gordo gorda sucios vagos",
        "V": "matar matare pegar romper golpear apunalar estrangular destrozar violar degollar quemar machacar reventar partir",
        "F": "morir mueras mueran muerto muerta muere pudras pudrete sufrir arder tumba arrepentir arrepentiras muerte sangrar",
        "E": "deportar deportados expulsar expulsados fuera eliminar exterminar exterminados encerrados encerrar prohibidos echar contraten",
        "S": "follar follarte chupar chupame coger cogerte joder mamar manosear sexo",
        "s": "desnudate besar besarte sexy cama tanga caliente cachonda noche lenceria",
        "N": "tetas culo polla verga cono desnuda desnudo desnudas desnudos pechos pene",
        "J": "manda mandame envia enviame ensena ensename muestrame muestra dame dejame ven quiero pasame",
        "Y": "tu te ti usted ustedes vosotros os", "y": "tus su", "M": "yo me mi mis conmigo nosotros nos", "H": "ella ellos ellas le les lo",
        "P": "jefe jefa companero companera reclutador reclutadora director directora tipo mujer hombre gerente encargado",
        "G": "extranjeros extranjero inmigrantes mujeres judios judio musulmanes negros viejos discapacitados gays homosexuales moros gitanos migrantes refugiados raza sudacas lesbianas africanos chinos",
        "p": "gente tipos pueblo", "L": "todos todas esos esas estos los las cada", "R": "debe deben deberia deberian deberias mereces merece merecen voy vas va van hay tienen tienes vamos", "h": "ojala espero deseo",
        "YC": "eres sois", "C": "es son soy era eran ser estas", "A": "un una unos unas el la los las muy tan todo todos de del lo verdadero pobre que mas nada solo",
        "l": "como", "n": "no nunca jamas ni ningun", "Z": "que", "O": "con para por",
        "Q": "reglamento prohibe acoso prohibido politica formacion curso taller denuncia denuncias victima victimas filtro moderacion detectar termino palabra ley tribunal clinica pacientes prevencion laboratorio estudio",
        "k": "y o pero porque", "x": "humana humano si en cuando despues antes",
        "T": "servidor proceso sistema sistemas procesos proyecto codigo maquina producto plazo",
    },
}

#: Endings of names of peoples that stand in no list.
PEOPLES = {"en": ("ites", "ite", "folk", "lander", "landers", "ians", "ian"), "de": ("leute", "iten", "lander", "ianer"), "fr": ("ites", "iens", "ais", "landais"), "es": ("itas", "ianos", "enses")}
#: Words with such an ending that name no people.
NO_PEOPLE = frozenset("site sites website websites suite suites favorite favourite favorites elite prerequisite prerequisites requisite composite composites white despite quite write invite opposite definite finite satellite technician technicians librarian librarians physician physicians guardian median historian electrician electricians dietitian statistician jamais mais anglais francais delais palais biais relais civilian custodian onsite offsite rewrite bite kite unite granite appetite polite".split())

#: Classes whose plurals and feminines are made by rule.
_INFLECTED = "IWPG"
_PLURAL = {"en": ("s", "es"), "de": ("e", "en", "er", "n", "s"), "fr": ("s", "e", "es"), "es": ("s", "es")}


def forms() -> dict[str, dict[str, str]]:
    """Class of every word form by language; a listed form goes before an inflected one."""
    out: dict[str, dict[str, str]] = {}
    for lang in LANGUAGES:
        table: dict[str, str] = {}
        order = [*"IKSNVFEWBbGsQJPpYyMHRhCnlZOLTAkx", "YC"]
        for kind in order:
            for w in WORDS[lang].get(kind, "").split():
                table.setdefault(w, kind)
        for kind in order:
            if kind in _INFLECTED:
                for w in WORDS[lang].get(kind, "").split():
                    for end in _PLURAL[lang]:
                        if len(w) > 2 and not (end == "s" and w.endswith("s")):
                            table.setdefault(w + end, kind)
        out[lang] = table
    for lang in LANGUAGES:  # context is understood whatever the language
        for other in LANGUAGES:
            for w in WORDS[other].get("Q", "").split():
                out[lang].setdefault(w, "Q")
    return out
