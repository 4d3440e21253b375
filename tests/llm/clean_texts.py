"""Clean sentences in other languages than those the models are fitted to, with accents and typed signs."""

OTHERS = """
Brontë wrote to Zoë about the fiancé and his protégée
Le garçon a mangé des crêpes à la fête de Noël, çà et là
L’élève préfère l’été où les fenêtres sont ouvertes
Où étiez-vous hier? Déjà à l’hôtel, près du château
La créée réélue a créé une société européenne
El niño comió piñas y mañana irá a España, ¿verdad?
¡Qué lástima! El señor Núñez llegó después del día quince
A ação das nações não é só coração, é também razão
Avó e avô estão no sertão com três irmãos
Perché l’università è più lontana della città? Così è la virtù
Però il caffè è già lì, giù in cantina
Der Käse schmeckt süß, aber die Soße ist für Größere
Älteste Übung: Öl, Äpfel und Würste für fünf Gäste
Smörgåsbord på svenska är gott på sjön i maj
Åsa såg på älgen när hon åkte över ån
Blåbærsyltetøy er på bordet ved døren, sa Bjørn
Rødgrød med fløde på en ø i å
Hääyöaie on pitkä yö, jäämme tänään kotiin
Töölöntori on hyvä paikka syödä päivällistä
Jäääär sulab kevadel, öö on lühike ja õhk külm
Það er gott að búa á Íslandi, þó ég sé þreyttur
Příliš žluťoučký kůň úpěl ďábelské ódy
Žena říká, že dítě běží k řece
Zażółć gęślą jaźń, mówił pięknie łódzki żółw
Święta w Łodzi są dłuższe niż myślał
Árvíztűrő tükörfúrógép és őszi szőlő
Șapte rațe și încă opt gâște în pădure
Çağdaş şiir gülünç değil, ılık rüzgâr esiyor
Đường phố Hà Nội rất đẹp vào buổi sáng
Người Việt Nam nói tiếng Việt
Čaša vode je đačkom đaku žedna šuma
Ķirsis ziedēja pavasarī, bērni gāja mājās
Ąžuolas žydėjo ėriukų pievoje švęsdamas
Їжак їв яблука, а їжа була смачна
Щоб їхати до Києва, треба є ґанок і кінь
Він є учнем і живе в місті біля річки
Ён жыве ў горадзе, дзе ёсць роўнае поле
Љубав је ђак који њише џак у ћошку
Ќе одам во Ѓорче, ѓаволот спие
Утре ще отидем на пазар и ще купим сирене
Қазақ тілі өте әдемі, ұлттық ән айтамыз
Καλημέρα κόσμε, στε και δε σε είδα πολύ
Η γλώσσα των Ελλήνων είναι παλιά
The £5 note and the 10 € coin cost ¥300 or 40 ¢
It is 20 °C, ± 2 %, about 5 µm × 3 µm, or ½ of ¼
An area of 10 m² and 3 m³, No. § 12, ¶ 3 · page 7
Acme® Widgets™ © 2020, see note ¹ and † below
Цена 300 ₽, вес 5 кг ± 10 г, температура −5 °C
Стоимость: 20 € или £15, см. § 4 и № 7
“Curly” and ‘single’ quotes — a dash… and an en–dash
„Deutsche“ Anführung und «französische» auch ›einfach‹
The piñata, the jalapeño and the soufflé à la carte
Ångström and Ørsted met Gödel; Dvořák and Čapek came too
São Paulo, Zürich, Kraków, Malmö, Reykjavík and Łódź
Señor Peña, Mme Lefèvre, Herr Weiß, fröken Åberg
x ≤ 3, y ≥ 4, z ≠ 0, π ≈ 3.14, √2, ∞, ∑ and ∫
a → b, ← back, ↑ up; ✓ done ★ three ☆
École, ÉCOLE, NOËL, GARÇON, ÜBER, ÑANDÚ
naïveté, coöperate, reëlect, façade, Chloë, Noël
über-cool café crème brûlée, vis-à-vis, déjà vu
""".strip().split("\n")
FRAMES = ("{}", "{}.", "He said: {} and then left", "Старый мельник сказал: {}, и ушёл")
TEXTS = [f.format(t) for t in OTHERS for f in FRAMES]
#: Written after the first set's parameters; two more floors were raised with these in view.
HELD_OUT = """
Mötley Crüe, Björk and Beyoncé sang “Für Elise” in Besançon
Ce n’était pas très élégant, mais la forêt brûlait là-bas
Les œufs et le bœuf coûtent 3 € à Orléans
Mañana por la mañana añadiré azúcar al café, ¡olé!
O pão de açúcar não é pão, é um órgão público
Caffè macchiato, tiramisù e un po’ di più a metà
Schön wär’s, sagte Frau Müßig, ½ Liter Öl für 2 €
Fåglarna sjunger på våren i Göteborg och Västerås
Æbler og pærer på Ærø koster 10 kr
Põõsas on öökull ja jõe ääres käib põder
Þórður fór út í bæ á föstudaginn
Dvořákův žák přišel včera večer příliš pozdě
Gżegżółka i pięć żab śpi na łące
Győr és Pécs közt több út is van
Ştefan și Ionuț văd că plouă în București
İstanbul’da güneş doğuyor, çok güzel bir gün
Tôi yêu Việt Nam và phở bò ở Huế
Під зіркою їде поїзд, а її їжак їсть гриби
Єдиний вихід є, ґрунт сухий, об’їзд закрито
Мы з’елі яблык і п’ём ваду ў хаце
Џорџ и Љиља иду у Ђердап, њима је лепо
Времето е хубаво и ще ходим на море
Бүгін күн жылы, әжем үйде отыр
Το σπίτι είναι δίπλα στη θάλασσα και τα δέντρα
Rate: ¥1,000 ± 5 %, £3.50 or €4.20 per m²; 25 °C
Temperature −3 °C, width ≥ 4 µm, ratio ≈ ½
""".strip().split("\n")
