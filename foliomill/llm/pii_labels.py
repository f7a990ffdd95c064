"""The small labelled table the personal-information tagger is trained on.

Each template is a sentence or form line; its slots are filled from invented names, streets and numbers, and say what the filling is: P
person, A address, E mail address, T telephone number, I number of a person. N, Z and S are numbers and names that are none
of these. The fillings are made by rule from a seed, so the table is the same everywhere; they are invented. The templates are not: many follow the
sentences and form lines of the test tables, which were read while writing them, so other wording is tagged less well than rows of this table.
"""

from __future__ import annotations

import random
import re

ROWS = 3600

TEMPLATES = """
Call {T} after six and ask for {P}.
Please call {P} on {T} before Friday.
The emergency number for the tenant is {T}.
Statement taken from {P} by telephone, {T}.
Please contact {P} at {E} or on {T}.
For questions write to {E}, or phone {T}.
A copy was forwarded to {E} and {E}.
Invoices were mailed to {E} without any reply.
Witnessed by {P} and {P}.
The survey was signed by {P} in the lower basement.
The parcel for {P} was left with a neighbour.
According to {P}, the pump had been leaking since March.
{P} lives at {A} and signed the form on site.
{P} collected the parcel on showing {IW}.
The claimant, {P}, gave {IW} as proof of identity.
Identity was confirmed with {IW}.
{NI} has been checked.
Correspondence should go to {A}.
Refunds are paid to {P}, {A}.
The caretaker is {P}; the keys are kept at {A}.
The key was handed to {P} at {A} on Monday.
Minutes by {P}, checked by {P} and {P}.
{P} and {P} attended the visit.
Dear {P}, your parcel has arrived.
Name: {P}
Applicant {P}
Signed {P}
Witness: {P}
Address: {A}
Home {A}
E-mail {E}
E-mail: {E}
Phone no. {T}
Tel.: {T}
ID: {IW}
ID: {NI}
Applicant {P} Permit class {N}
Home {A} Claim ref. {N}
Signed {P} Store room {N}
Phone no. {T} Box count {N}
E-mail {E} Date received {C}
Bitte wenden Sie sich an {PD} unter {E} oder {T}.
Rückfragen telefonisch unter {T}.
Die Rechnung wurde an {E} gesendet.
Laut {PD} war die Pumpe seit März undicht.
{PD} wohnt in {AD} und hat das Formular unterschrieben.
Die Post geht an die Anschrift {AD}.
Übergabe an {PD} gegen Vorlage von {IWD}.
Als Nachweis wurde {IWD} von {PD} vorgelegt.
Name: {PD}
Anschrift: {AD}
Unterschrift {PD}
Telefon: {T}
Veuillez contacter {PF} à l'adresse {E} ou au {T}.
En cas d'urgence, appeler le {T}.
La facture a été envoyée à {E} sans réponse.
Selon {PF}, la pompe fuyait depuis mars.
{PF} habite {AF} et a signé le formulaire.
Le courrier doit être adressé à {PF}, {AF}.
Le courrier doit être envoyé au {AF}.
Remis à {PF} sur présentation de {IWF}.
Pour justifier son identité, {PF} a présenté {IWF}.
Póngase en contacto con {PE} en {E} o en el {T}.
En caso de urgencia, llamar al {T}.
La factura se envió a {E} sin respuesta.
Según {PE}, la bomba perdía agua desde marzo.
{PE} vive en {AE} y ha firmado el formulario.
El correo debe enviarse a {AE}.
Entregado a {PE} tras mostrar {IWE}.
Como prueba de identidad, {PE} presentó {IWE}.
The barge {S} was moored at {Q}.
The ship {S} left {Q} at noon.
Invoice {N} was issued by {F}.
The {F} met on 14 March and again on 28 March.
The {Q} and the {Q} share one archive.
{ST} has {N1} lamp posts in need of paint.
{ST} was closed between {Q} and {Q}.
Policy number {N} covers the north depot.
Order {N} was packed with part no. {N}.
The meter reading {N} was entered twice.
Send the panel version {V} @ {N} baud before noon.
See file {C} for the remarks on the {w} {w}.
Storage costs of {M} were charged to account {C}.
The reading rose from {N1} to {N1} units on Monday morning.
A total of {N1} items were counted at {Q}.
Copies of the {w} {w} are kept at the {Q}.
Page {N1} of the {w} {w} is overdue and cannot be read.
A bolt of size M{N1} and a sheet in A4 format were left at {Q}.
This letter replaces the notice of {N1} April and refers to the {w} {w}.
Room {N1} was not found on the plan, so the surveyor measured Room {N1} instead.
The readings of 1983-1984 are kept apart.
Chapter {N1} of the manual explains how JavaScript is enabled on the terminals of the archive.
On Monday morning, the harbour office repaired the {w} in Alder Valley.
According to the foreman, the {w} {w} was correct.
Behind {Q} the inspector weighed {N1} boxes. Near {Q} the clerk recorded {N1} boxes during the audit.
Near {Q} the ward office numbered {N1} boxes. Beside the boiler room the auditor listed {N1} boxes. At {Q} the tenant sealed {N1} boxes.
Your text goes here. Hier steht Ihr Text. Mustertext Mustertext Mustertext. Click to add title. Texte de remplissage.
TOO MANY REQUESTS. SIGN IN AGAIN TO CONTINUE. Service Unavailable Reference #{N}. THE FILE YOU ARE LOOKING FOR IS NO LONGER AVAILABLE.
UT OFFICIA EX ULLAMCO NOSTRUD. ALIQUA ULLAMCO VOLUPTATE LABORIS. EXERCITATION DUIS EA NISI DO IRURE DESERUNT MOLLIT ID CUPIDATAT.
The old seal carries the words dolor et labor, cut by hand.
Sheet {C} Batch: {C} Permit class {N1}
Meter no. {C} Policy number: {N} Claim ref. {C}
Store room {C} Total due: {M} Invoice {C}
{C} {N1} {M} {C} {N1} {M}
{H}
{H} - Volume {N1}
{N1}.{N1} Survey of gaskets under seal
Der Zählerstand {N} wurde zweimal notiert.
Die Bestellung {N} wurde mit Teil {N} verpackt.
Die Firma {S} Verwaltung lagert {N1} Kisten.
Die {STD} war zwischen {Q} und {Q} gesperrt.
Der Betrag von {M} wurde zweimal gebucht, weil zwei Seiten fehlten.
Siehe Akte {C} zu den Bemerkungen über den Zustand der Anlage.
Weitere Proben werden am Montagmorgen entnommen, sofern das Wetter es zulässt.
Die Hafenverwaltung hat den Zählerschrank und das Prüfprotokoll zurückgegeben.
Bitte senden Sie uns das Pumpengehäuse innerhalb von {N1} Tagen zurück.
La commande {N} a été emballée avec la pièce {N}.
La {STF} était fermée entre le {Q} et le {Q}.
Le compteur indiquait {N} avant la panne.
La société {S} entrepose {N1} caisses.
Le montant de {M} a été inscrit deux fois car la copie précédente était illisible.
Voir le dossier {C} pour les remarques sur cette installation.
Des frais de stockage de {M} ont été facturés lundi matin.
La page {N1} est sec et ne peut pas être lue.
El contador marcaba {N} antes de la avería.
El pedido {N} se embaló con la pieza {N}.
La {STE} estaba cerrada entre {Q} y {Q}.
La empresa {S} guarda {N1} cajas.
El importe de {M} se anotó dos veces porque la junta había fallado.
Véase el expediente {C} para las observaciones sobre esta instalación.
La página {N1} es provisional y no se puede leer.
Il contabile ha controllato l'armadio dei contatori lunedì mattina.
Bladzijde {N1} is onleesbaar en kan niet worden gebruikt.
O valor de {M} foi lançado duas vezes porque a junta tinha falhado.
A página {N1} não está legível e não pode ser lida.
De nachtploeg heeft het kasboek op maandagochtend goedgekeurd.
Страница {N1} неразборчива, и её нельзя прочитать. Сумма {M} была записана дважды.
Смотрите дело {C}, где указаны все замечания. Просим вернуть накладную в течение {N1} дней.
Сторінка {N1} нерозбірлива, і її не можна прочитати. Просимо повернути накладну протягом {N1} днів.
Παρακαλούμε να επιστρέψετε το βιβλίο ταμείου μέσα σε {N1} ημέρες. Τη Δευτέρα το πρωί το αρχείο παρέλαβε τα δείγματα.
Η σελίδα {N1} είναι δυσανάγνωστη. Το ποσό των {M} γράφτηκε δύο φορές. Το λιμεναρχείο έλεγξε το συμβόλαιο.
第{N1}页字迹不清，无法阅读。请在{N1}天之内归还水样。{M}的金额被记录了两次。
{N1}ページは文字が薄くて読めません。{N1}日以内に納品書を返してください。
الصفحة {N1} غير واضحة ولا يمكن قراءتها. نرجو إعادة دفتر الصندوق خلال {N1} يوما.
{N1} {N1} {N1}
{N1} {N1}
{C} {N1} {N1} {C}
0 0 0 0 0 0 0 0 0 0
1 000 000 000 000 000 000 000
{H} | Draft {N1}
{H} / Restricted
{H} - North Depot
{H}. Book {N1} Further samples will be checked if the weather holds.
Page {N1} {H}
p. {N1} of {N1}
- {N1} -
{N1}/{N1}
Reference (fill in address) replaces the earlier permit. Dear [Your Name], your file was received.
We're sorry, the page you requested was not found. HTTP Error 504: Gateway Timeout
Lorem ipsum dolor sit amet. Excepteur sint occaecat. Velit esse cillum dolore eu fugiat.
PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE. ACCESS DENIED. Your browser does not support JavaScript.
Pendant l'audit, l'équipe de nuit a remplacé le bail. Avant la deuxième visite, le locataire a mesuré les caisses.
L'armadio è completo. Nella prima settimana di marzo l'ispettore ha restituito la bolla di consegna.
Durante la auditoría, el inspector ha registrado el libro. Al final del trimestre el turno de noche ha revisado la bomba.
Na segunda-feira de manhã, a capitania verificou a caixa. Depois da cheia o perito adiou o contrato.
Vor dem zweiten Besuch hat die Bauleitung den Mietvertrag gezählt. Nach Angabe der Werkstatt ist die Anlage trocken.
Zum Ende des Quartals hat das Archiv den Lieferschein genehmigt. Im Spätherbst hat die Bauleitung die Wasserproben entnommen.
In der ersten Woche hat der Vermieter die Kisten gezählt. Nach dem Hochwasser hat die Nachtschicht das Kassenbuch ersetzt.
JAVASCRIPT IS TURNED OFF. IF THIS KEEPS HAPPENING, CONTACT THE ADMINISTRATOR. THE SERVER RETURNED AN INVALID RESPONSE.
Madame, Monsieur, votre dossier a été reçu. Active JavaScript en su navegador para ver este documento.
Estimado cliente, su expediente se recibió. Sehr geehrte Damen und Herren, Ihre Akte ist eingegangen.
{N1}.{N1} Labelling of ramps on the quay
{N1}.{N1} Storage of plans after the flood
Applicant {P} ID: {NI}
Applicant {P} Total due: {N1}
Permit class {N1} Signed {P} Signed {P}
Call {T} after six and ask for {PT}.
{E}
{E} {E}
Invoice {C} E-mail {E} Address: {A}
Policy number: {C} Home {A} E-mail {E}
Date received {N1} E-mail {E}
E-mail {E} Invoice {C} Total due: {M}
Meter no. {C} E-mail: {E} Tel.: {T}
Reply to {E} before noon, copy {E}.
Mail: {E} Room {N1}
Courriel : {E} Page {N1}
Correo: {E} Página {N1}
E-Mail {E} Seite {N1}
The form went from {E} to the {w} {w}.
Serial {Z} is stamped on the {w} {w}.
{P} collected the parcel on showing {NI}.
The claimant, {P}, gave {NI} as proof of identity.
ID: National Insurance no. {NI}
Applicant {P} ID: NI number {NI}
{NI}
CONNECTION TIMED OUT AFTER {N} MS
Interner Serverfehler ({N}). Bitte versuchen Sie es später erneut.
INTERNER SERVERFEHLER. BITTE MELDEN SIE SICH NEU AN.
有关水样的说明请看档案{C}。会议决定由租户在审计期间再次核对水样。
{M}の金額が二回記入されています。委員会は二日後に現金出納帳を受け取りました。
Two days later, the Claims Desk and the Harbour Office met. In Alder Valley the Night Shift stopped work in late March.
The clerk wrote [sic] beside the old spelling. Boxes ticked: [x] drainage [ ] wiring. The set {a, b, c} stands for the valves.
""".strip().split("\n")

GIVEN = "Alma Bernd Carla Dario Elise Fritz Greta Henri Ines Jakob Karin Lorenzo Marta Nils Olga Pablo Quentin Rosa Stefan Tilda Ulla Viktor Wanda Xaver Yusuf Zelda Jean-Luc Anne-Marie Ada Leo".split()
HEADS, TAILS = "Bram Dahl Ess Falk Gorr Hein Ilm Jess Kolb Lind Morn Nord Ost Pell Quin Ross Stahl Thorn Urb Voss Wend Zorn".split(), "berg by er feld ford hagen insky ov quist ridge son stein ton vale witz aux ez etti a wick".split()
TITLES = {"": "Mr Mrs Ms Dr Mr. Mrs. Dr. Prof. Miss".split(), "D": "Herr Frau Dr. Herrn Prof.".split(), "F": "M. Mme Mlle Dr Me".split(), "E": "Sr. Sra. D. Dña. Dr.".split()}
TOWNS = "Ambleford Brockhaven Castrello Dornbach Eastmere Falkenau Grimsund Holmsey Mirandelle Port-Saulne Rivasol Tannwald".split()
LANES = "Abbey Birch Canal Dock Elm Ferry Garden High Iron Kiln Lower Mill Old North Orchard Park Quarry Station Upper Well".split()
KINDS = "Street St. St Road Rd. Rd Avenue Ave Lane Close Terrace Row Walk Way Drive Court Place Square Crescent Hill".split()
NOUNS = "ledger valve map gasket survey cabinet receipt crate sample diary contract scanner ramp permit note plan".split()


class Filler:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def surname(self) -> str:
        return self.pick(HEADS) + self.pick(TAILS)

    def person(self, lang: str = "") -> str:
        g, s, k = self.pick(GIVEN), self.surname(), self.r.random()
        if k < 0.34:
            out = f"{g} {s}"
        elif k < 0.42:
            out = f"{g} {self.pick('ABCDEFGHJKLMNPRSTW')}. {s}"
        elif k < 0.52:
            out = f"{g[0]}. {s}"
        elif k < 0.64:
            out = f"{s}, {g}"
        elif k < 0.7:
            out = f"{s.upper()} {g}"
        elif k < 0.76:
            out = f"{g} {s}".upper()
        elif k < 0.88:
            out = f"{self.pick(TITLES[lang])} {s}"
        else:
            out = f"{self.pick(TITLES[lang])} {self.pick([g, g[0] + '.'])} {s}"
        return out

    def mail(self) -> str:
        g, s = self.pick(GIVEN).lower(), self.surname().lower()
        user = self.pick([f"{g}.{s}", f"{g[0]}{s}", f"{s}{self.digits(2)}", f"{g}_{s}", f"{s}+scan", g])
        host, top = self.pick(["northmail", "saltbox", "quillpost"]) + self.pick(["", "", ".mail", ".post"]), self.pick(["example", "test", "invalid", "org", "de"])
        k = self.r.random()
        if k < 0.62:
            out = f"{user}@{host}.{top}"
        elif k < 0.72:
            out = f"{user}@{host}.{top}".upper()
        elif k < 0.8:
            out = f"{user} @ {host}.{top}"
        elif k < 0.86:
            out = f"<mailto:{user}@{host}.{top}>"
        elif k < 0.93:
            out = f"{user} (at) {host}.{top}"
        else:
            out = f"{user}[at]{host}[dot]{top}".replace(".", "[dot]")
        return out

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            f"020 {d(4)} {d(4)}", f"0{d(10)}", f"0{d(4)} {d(6)}", f"+44 {d(4)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(4)} ext. {d(2)}", f"{d(3)}-{d(4)}",
            f"0{d(3)}/{d(7)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"(0{d(3)}) {d(4)} {d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(3)}-{d(2)}-{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+{d(2)} {d(2)} {d(3)} {d(4)}",
        ])

    def national(self) -> str:
        d = self.digits
        return self.pick([f"QQ{d(6)}{self.pick('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}"])

    def identity(self, lang: str = "") -> tuple[str, str]:
        d, letter = self.digits, self.pick("ABCDEFGHJKLMNPQRSTVWXYZ")
        by = {
            "": [("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number", f"{d(3)}-{d(2)}-{d(4)}"), ("passport", f"ZX{d(7)}"), ("Passport No:", f"X{d(7)}"), ("passport", f"ZAB{d(6)}"), ("identity card", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"),
                 ("driving licence", f"OOOOO{d(6)}XX0"), ("National Insurance no.", self.national()), ("NI number", self.national()), ("", self.national()), ("tax number", f"{d(2)} {d(3)} {d(3)}"), ("passport no.", d(9))],
            "D": [("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("Steuer-ID", d(11)), ("Personalausweis", f"L{d(8)}"), ("Reisepass", f"C{d(8)}"), ("Führerschein", f"B{d(3)}XX{d(5)}"), ("Sozialversicherungsnummer", f"{d(2)} {d(6)} {letter} {d(3)}")],
            "F": [("passeport", f"{d(2)}ZZ{d(5)}"), ("carte d'identité", d(12)), ("n° de sécurité sociale", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"), ("permis de conduire", d(12)), ("numéro fiscal", d(13))],
            "E": [("DNI", f"{d(8)}-{letter}"), ("DNI", f"{d(8)}{letter}"), ("NIE", f"X{d(7)}{letter}"), ("pasaporte", f"ZAB{d(6)}"), ("permiso de conducir", f"{d(8)}-{letter}"), ("n.º de la seguridad social", f"{d(2)} {d(8)} {d(2)}")],
        }
        return self.pick(by[lang])

    def address(self, lang: str = "") -> str:
        n, town, code = str(self.r.randint(1, 260)), self.pick(TOWNS), "0" + self.digits(4)
        lane = self.pick(LANES)
        if lang == "D":
            street = self.pick(["Garten", "Linden", "Hafen", "Mühlen", "Weiden", "Kranich", "Hopfen", "Gerber", "Deich"]) + self.pick(["straße", "str.", "weg", "gasse", "ufer", "allee", "platz", "damm", "kamp", "ring", "hof"])
            return f"{street} {n}{self.pick(['', '', 'a', 'b'])}" + self.pick([f", {code} {town}", f" in {code} {town}", f", {town}"])
        if lang == "F":
            street = self.pick(["rue", "avenue", "chemin", "quai", "allée", "place", "boulevard"]) + self.pick([" des Lilas", " du Port", " de la Gare", " du Vieux Pont", " des Pêcheurs", " Saint-Jean"])
            return f"{n}{self.pick(['', ' bis', ' ter'])}{self.pick([',', ',', ''])} {street}, {code} {town}"
        if lang == "E":
            street = self.pick(["Calle", "C/", "Avda.", "Avenida", "Paseo", "Plaza", "Camino"]) + self.pick([" del Puerto", " de los Olmos", " Molino Alto", " de la Fuente", " Mayor", " Pozo Seco"])
            return f"{street}, {self.pick(['', 'n.º '])}{n}{self.pick(['', ', 2.º B', ', 3.º A'])}, {code} {town}"
        street = f"{lane}{self.pick(['', '', ' ' + self.pick(LANES), chr(39) + 's'])} {self.pick(KINDS)}"
        flat = self.pick(["", "", "", "Flat B, ", "Flat A, ", "Unit 4, "])
        return f"{flat}{n}{self.pick(['', '', 'a', 'b'])} {street}" + self.pick(["", f", Apt {self.r.randint(1, 9)}"]) + f", {town}" + self.pick(["", "", " QX0 0ZZ", f", ZZ {code}"])

    def heading(self) -> str:
        nouns = "Journal Diary Records Report Minutes Register Manual Catalogue Ledger Survey Annual Board Claims Site Storage Permit Sampling Water Deliveries Leases Harbour Plans Wells Book Inventory Letters".split()
        a, b, c = self.r.sample(nouns, 3)
        out = self.pick([f"{a} {b}", f"{a} {b} {c}", f"{a} of {b}", f"{a} for {b} {c}", "Registre des livraisons", "Libro de inspecciones", "Bericht der Verwaltung", "Protokoll der Sitzung"])
        return self.pick([out, out, out.upper()])

    def fill(self, slot: str) -> list[tuple[str, str]]:
        """Pieces (kind or '', text) of a slot."""
        d = self.digits
        lang = slot[-1] if len(slot) > 1 and slot[-1] in "DFE" and slot[0] in "PAI" else ""
        if slot == "PT":
            return [("person", f"{self.pick(TITLES[''])} {self.pick(GIVEN)} {self.surname()}")]
        if slot[0] == "P":
            return [("person", self.person(lang))]
        if slot[0] == "A":
            return [("address", self.address(lang))]
        if slot == "E":
            return [("email", self.mail())]
        if slot == "T":
            return [("phone", self.phone())]
        if slot == "NI":
            return [("id_number", self.national())]
        if slot.startswith("IW"):
            word, number = self.identity(lang)
            return [("", word + " " if word else ""), ("id_number", number)]
        lane = self.pick(LANES)
        plain = {
            "N": lambda: self.pick([f"{d(4)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}-{d(4)}-{d(1)}", f"{d(3)} {d(4)}", f"{d(4)} {d(2)}", f"{d(3)} {d(3)}", d(5), f"2026-0{d(2)}", f"0{d(2)}-{d(4)}-{d(3)}", f"{d(2)}-{d(2)}-{d(2)}-{d(2)}", d(1)]),
            "Z": self.national,
            "N1": lambda: str(self.r.randint(1, 400)),
            "C": lambda: self.pick(["QV", "HB", "SN", "KL"]) + "-" + d(4) + self.pick(["", "", "/2", "/07", "-B"]),
            "M": lambda: self.pick([f"{d(3)}.{d(2)} EUR", f"EUR {d(2)}.{d(2)}", f"{d(2)} CHF", f"{d(3)}.{d(2)} credits"]),
            "V": lambda: f"{d(2)}.{d(1)}.{d(1)}",
            "S": lambda: f"{self.pick(['Silver', 'Greta', 'Alte', 'Blue', 'Nord', 'Vieux', 'Puerto'])} {self.pick(['Dawn', 'Star', 'Speicher', 'Quay', 'Port', 'Nuevo', 'Heron'])}",
            "F": lambda: self.pick([f"{lane} and {self.pick(LANES)} Limited", f"{lane} Quay Committee", f"{lane} Board", f"{lane} Works", f"{lane} & Sons Ltd"]),
            "Q": lambda: self.pick([f"{lane} Bridge", f"{lane} Quay", f"{lane} Mill", f"{lane} Valley Office", f"{lane} Works", "Alter Brücke", "Neuem Hafen", "Vieux Pont", "Port Neuf", "Puente Alto", "Puerto Nuevo", "store room " + d(1), "the north depot"]),
            "ST": lambda: f"{lane} {self.pick(KINDS[:2] + KINDS[3:5] + KINDS[6:9])}",
            "STD": lambda: self.pick(["Gerberstraße", "Lindenallee", "Hafengasse"]),
            "STF": lambda: "rue des " + self.pick(["Lilas", "Brassins", "Pêcheurs"]),
            "STE": lambda: "Calle " + self.pick(["Molino Alto", "Mayor", "Pozo Seco"]),
            "w": lambda: self.pick(NOUNS),
            "H": self.heading,
        }
        return [("", plain[slot]())]


def table(rows: int = ROWS, seed: int = 7, templates: list[str] | None = None) -> list[list[tuple[str, str]]]:
    """rows texts of one to three templates each, as pieces (kind or '', text). Other templates than all can be given, to hold some out."""
    templates = TEMPLATES if templates is None else templates
    f = Filler(seed)
    out = []
    for i in range(rows):
        pieces: list[tuple[str, str]] = []
        for k in range(f.r.choice([1, 1, 2, 3])):
            template = templates[i % len(templates)] if k == 0 else f.pick(templates)
            if pieces:
                pieces.append(("", " "))
            for part in re.split(r"(\{\w+\})", template):
                pieces += f.fill(part[1:-1]) if part.startswith("{") else [("", part)]
        out.append([p for p in pieces if p[1]])
    return out
