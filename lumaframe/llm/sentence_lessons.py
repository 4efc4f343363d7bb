"""What the sentence model learns from: abbreviations and marked passages.

In the passages ``|`` stands where a sentence ends, ``#`` for a number and ``@`` for a
small whole one.  They tell of gardens, voyages, kitchens, trains and museums, and each
subject is a block of its own, so that whole subjects can be held out.  They are joined
at random, with and without their final marks and with odd spacing, to make the labelled
sequences of the training (see ``sentences.train``).
"""

from __future__ import annotations

# Abbreviations that a sentence goes on after, whatever follows.
ALWAYS_ON = """
mr mrs ms dr prof st sr jr vs cf e.g i.e approx fig figs no nos sec ch vol p pp ed eds max min avg
dept est gen col capt lt sgt rev hon eq al ca resp incl excl viz mt ft gov sen rep
nr abb bd bzw z.b d.h u.a s.o s.u lt hr fr dipl ing kap tab vgl evtl ggf inkl zzgl mind str tel z
env mm mme mlle m p.ex c.-à-d chap art réf éd av bd
sra dra núm pág págs máx mín aprox ej p.ej ud uds dña cap
डॉ क्र श्री पृ सं
د ص أ م هـ ج
พ.ศ ค.ศ น ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค ดร กม
г ул им стр рис гл см т.е т.к напр проф акад руб
κ κα δρ καθ π.χ βλ σελ αρ δηλ οδ
""".split()

# Abbreviations that may well end a sentence.
MAY_END = "etc usw ff f a.m p.m inc ltd co corp bros u.s u.k ph.d a.d b.c o.ä u.ä s.a т.д т.п др κ.λπ κ.ά".split()

# Words before a day or floor number in German, and its months.
ORDINAL_LEADS = "am im vom zum der den dem des das die bis seit ab beim jeden".split()
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()

LESSONS = {
    "en": {
        "garden": """
The roses came late this year.| Nobody had pruned them.| What a pity!|
Did the frost kill the beans?| It did not.| They are climbing again.|
Plant them # cm deep, i.e. two fingers, and wait.| Rain does the rest.|
Herbs, e.g. Thyme or sage, like it dry.| So do we.|
We grow plums, pears, figs, etc. along the wall.| The wall faces south.|
We grow plums, pears, figs, etc.| The wasps love them.|
Seed packet No. # had gone missing.| No. # was empty.|
"Water it. Then water it again." is what her father used to say.| She never forgot.|
Vitamin C is what they lack.| Take vitamin C.| Then rest.|
The soil is # % clay.| The rest is sand.| See p. # of the almanac.|
It costs #.# pounds a sack.| Two sacks will do.|
""",
        "voyage": """
Capt. Hale left the bridge at # a.m. and slept.| At # p.m. he woke.|
They sailed at # a.m.| The harbour was still dark.| Nobody waved.|
"Land! Land at last!" echoed across the deck.| The crew wept.|
He shouted, "Hold on!" and vanished below.| A wave broke.|
The mate said: "We are lost."| No one contradicted him.|
"Where are we?" asked the boy.| "At sea."|
The U.S. Navy sent a tug.| It arrived too late.| The tug came from the U.S.| The crew did not.|
The U.K. Admiralty kept silent.| So did the press.|
Smith & Co. Ltd. owned the ship.| The Hull Trading Co. Ltd. was bankrupt by then.| It belonged to Baker Bros.| The name is forgotten.|
St. Helena lay # miles off.| Mt. Actaeon was hidden in cloud.|
The log (kept by Lt. Grey. He was ill.) breaks off here.| Pages are torn out.|
We waited...| Then the wind turned.| It was... well, a relief.|
He counted to #... and fell asleep.| The sea fell... nobody moved.|
The depth fell to #.| Sand everywhere.| It fell again to #.#.| Rocks!|
The anchor held.(The chain did not.)| We drifted.|
""",
        "letters": """
J. S. Bach wrote it, not W. F. Bach.| The copy is by A. M. Bach.|
Prof. Lund and Mrs. Vega disagree (cf. ch. # and vol. #, pp. # ff.).| Let them.|
Her thesis (Ph.D. Uppsala) is lost.| He got his Ph.D.| It took nine years.|
The word "finis." closes the book.| A blank leaf follows.|
The telegram read "Come home."| She took the night train.|
The inscription says "Rest."| Below it stands a date.|
Read letter_#.v#.txt first.| Then open notes.#.pdf or visit www.example.org today.|
Release v#.#.# broke it.| v#.# had been fine.| Was it tested?!| Hardly!!!|
Rome fell in #.| The date is disputed.| In # it burned.|
There were about # of them, max. #, min. #.| Good.|
The temple dates from # B.C. or so.| It was rebuilt in # A.D.| Nothing is left.|
A postcard 🏝️ of the island was enclosed.| It showed # palms 🌴 in a row.|
Is it true?| Yes.| Is it?| No.| Never mind.|
Sec. #.# applies; see fig. #.| Otherwise nothing does.|
(They had quarrelled.)| Peace came in spring.|
My aunt (how she laughed!) went home.| The jar (it said "Do not open.") stood empty.| A recipe (see above.) calls for rum.|
Old vs. new spelling: both stand.| approx. # words differ.|
Jars were filled with oil.Then they were sealed.| That was all.|
""",
    },
    "de": {
        "garten": """
Die Rosen blühen spät.| Keiner hat sie geschnitten.| Schade!|
Hat der Frost die Bohnen geholt?| Zum Glück nicht.|
Man sät am @. März, spätestens am @. April.| Danach ist es zu spät.|
Kräuter, z. B. Thymian, mögen es trocken.| Wir auch.|
Wir ziehen Birnen, Pflaumen usw. an der Mauer.| Die Mauer ist warm.|
Wir ziehen Birnen, Pflaumen usw.| Die Wespen freut es.|
Im @. Beet wächst nichts.| Das @. Beet ist leer.| Vom @. Juni an blüht es.|
Der Sack kostet #,# Euro, d. h. zu viel.| Zwei reichen.|
„Gießen. Und noch einmal gießen!“ pflegte Opa zu sagen.| Er hatte recht.|
Beutel Nr. # fehlt.| Vgl. S. # ff. im Kalender.|
Der Brief (s. u.) lag offen da.| Die Tante (wie sie lachte!) ging heim.| Das Rezept (vgl. oben.) braucht Rum.|
""",
        "reise": """
Hr. Kapitän Dr. Voss schlief um # Uhr.| Dann kam der Sturm.|
Sie fragte: „Wo sind wir?“| Keiner wusste es.|
„Land in Sicht!“ rief der Junge und weinte.| Alle liefen an Deck.|
Auf dem Schild steht „Kein Zutritt.“ in roter Farbe.| Wir gingen hinein.|
Der Zug hielt in #.| Niemand stieg aus.| Er fuhr weiter nach #.|
Der Wagen (Bj. #, Bd. # der Reihe) ist alt.| Er rollt.|
Warten wir... vielleicht kommt er noch.| Der Kurs fiel auf #...| Alle schwiegen.|
Er zählte bis #... und schlief ein.| Das Meer sank... niemand rührte sich.|
Das Haus stammt von # bzw. #.| Genaues weiß man nicht.|
Im @. Stock wohnt Fr. Lang.| Sie hört schlecht.|
Er kam ca. # Mal, evtl. öfter, lt. Kap. # jedenfalls.| Gut.|
""",
    },
    "fr": {
        "jardin": """
Les roses fleurissent tard.| Personne ne les taille.| Quel dommage !|
Le gel a-t-il tué les haricots ?| Non.| Ils montent.|
On sème à env. # cm, c.-à-d. deux doigts.| La pluie fait le reste.|
Poires, prunes, figues, etc. longent le mur.| Le mur est chaud.|
Poires, prunes, figues, etc.| Les guêpes adorent.|
Le sac no. # coûte #,# euros.| Deux suffisent.|
« Arrose. Arrose encore ! » répétait son père.| Elle s'en souvient.|
M. Leroy et Mme Petit vivent ici.| Ils sont vieux.|
""",
        "voyage": """
Le train part à # heures.| Personne ne descend.|
Elle demande : « Où sommes-nous ? »| On se tait.|
Il a crié « terre ! » et il a pleuré.| Tout le monde court.|
Voir chap. # et p. # du guide, fig. # aussi.| Le reste est faux.|
Attends... il viendra peut-être.| Le prix tombe à #...| Silence.|
Il compta jusqu'à #... puis s'endormit.| La mer baissait... personne ne bougea.|
Quelle mer !| Quel vent !| Pourquoi partir ?|
L'île a # habitants.| Le phare date de #.| On y mange bien.|
L'affiche (« Entrée libre. Merci. ») est tombée.| Tant pis.|
Ma tante (elle riait !) est partie.| La lettre (voir plus haut.) est perdue.|
""",
    },
    "es": {
        "jardin": """
Las rosas llegan tarde.| Nadie las poda.| ¡Qué pena!|
¿El hielo mató las judías?| No.| ¡Siguen vivas!|
Se siembra a aprox. # cm, p. ej. en marzo.| La lluvia hace el resto.|
Hay peras, ciruelas, higos, etc. junto al muro.| El muro es cálido.|
Hay peras, ciruelas, higos, etc.| Las avispas vienen.|
El saco núm. # cuesta #,# euros.| Con dos basta.|
«Riega. ¡Riega otra vez!» repetía su padre.| Ella lo recuerda.|
""",
        "viaje": """
El Sr. Vega y la Dra. Luna viajan juntos.| Nadie los espera.|
Ella preguntó: «¿Dónde estamos?»| Nadie supo.|
Gritó «¡tierra!» y lloró.| Todos corrieron.|
Véase la pág. # y el cap. # de la guía.| Lo demás sobra.|
Espera... quizá venga.| El precio cayó a #...| Silencio.|
Contó hasta #... y se durmió.| El mar bajaba... nadie se movió.|
El tren sale a las #.| El faro es de #.| ¿Quién lo cuida?|
El máx. fue # y el mín. #.| Hizo frío.|
Mi tía (¡cómo reía!) se fue.| La carta (véase arriba.) está perdida.|
""",
    },
    "zh": {
        "田园": """
今年的玫瑰开得很晚。|没有人修剪它们。|真可惜！|
豆角冻死了吗？|没有。|它们又爬上了墙。|
种子要埋#厘米深，水不要太多。|剩下的交给雨水。|
“浇水！再浇水。”爷爷总是这样念叨。|她一直记得。|
奶奶问：“饭好了吗？”|厨房里没有声音。|
“快来看！”弟弟在院子里喊。|大家都跑了出去。|“下雨了。快收衣服！”邻居喊道。|
每袋#元，两袋就够了！|多少钱？！|太贵了！！|
院门上贴着"Push. Do not pull."的纸条。|谁也没注意。|
“起床了！太阳出来了。”妈妈推开窗户。|鸟儿叫个不停。|“别怕。跟我来。”老人低声说。|孩子点点头。|
“再等等！雨会停的。”园丁望着天空。|云散了。|“真香！是谁做的？”客人们围了过来。|
他叹了口气：“老了。”|说完便睡着了。|
""",
        "旅途": """
船在凌晨出发。|码头上一片漆黑。|
“到岸了！到岸了！”的喊声传遍甲板。|船员们哭了。|
船长说：“我们迷路了。”|没有人反驳。|
等一等……风向变了。|那是……怎么说呢，一种解脱。|
参见第#章、No.#和附录#.#。|书已经绝版。|
列车开往北京站，时速#公里，晚点#.#小时。|乘客们睡着了。|
灯塔建于#年。|岛上住着#个人。|因为没有桥，大家坐船。|
信的结尾是“勿念。”几个字。|信封不见了。|墙上写着“禁止吸烟！”，却没人遵守。|
""",
    },
    "ja": {
        "庭": """
今年のバラは遅く咲いた。|誰も剪定しなかった。|残念だ！|
豆は枯れたか？|枯れていない。|また伸びている。|
種は#センチの深さに埋める。|あとは雨に任せる。|
「水をやれ。もう一度やれ。」が祖父の口ぐせだった。|忘れたことはない。|
「ごはんはまだ？」と弟が聞いた。|台所は静かだ。|
「雨だ！洗濯物を入れて！」と隣の人が叫んだ。|みんな走った。|
「起きて！朝だよ。」と母が窓を開けた。|鳥が鳴いている。|「怖くない。ついておいで。」と老人がささやいた。|子どもはうなずいた。|
「待って。雨はやむ。」と庭師は空を見た。|雲が切れた。|「いい匂い！誰が作ったの？」と客が集まってきた。|
一袋#円で、二袋あれば足りる。|高い！|
""",
        "旅": """
船は夜明け前に出た。|港は暗かった。|
「陸だ！」という叫びが甲板に響いた。|船員は泣いた。|
船長は言った：「迷った。」|誰も答えない。|
待って……風が変わった。|それは……救いだった。|
第#章とNo.#、図#.#を見よ。|本は絶版だ。|
手紙は「元気で。」で終わる。|封筒はない。|
灯台は#年に建てられた。|島には#人が住む。|橋はないのか？|ない。|
看板に「立入禁止。」とあるが、誰も守らない。|困った。|
""",
    },
    "ko": {
        "정원": """
올해 장미는 늦게 피었다.| 아무도 가지를 치지 않았다.| 아깝다!|
콩이 얼어 죽었나요?| 아니요.| 다시 자라고 있습니다.|
"물을 줘. 또 줘." 할아버지는 늘 그렇게 말씀하셨다.| 나는 기억한다.|
한 봉지에 #.#달러입니다.| 두 봉지면 됩니다.|
배는 새벽 @시에 떠났다.| 항구는 어두웠다.| 선장은 말했다: "길을 잃었다."| 모두 조용했다.|
잠깐... 바람이 바뀌었다.| 제#장과 그림 #을 보라.| 등대는 #년에 세워졌다.|
""",
    },
    "ru": {
        "сад": """
Розы зацвели поздно.| Никто их не подрезал.| Как жаль!|
Мороз погубил бобы?| Нет.| Они снова растут.|
Дом стоит на ул. Садовой в г. Твери.| Он пуст.| См. рис. # и стр. # в гл. #.| Этого хватит.|
Груши, сливы и т. д. растут у стены.| Стена тёплая.| Мы любим груши, сливы и т. д.| Осы тоже.|
«Поливай. Ещё поливай!» — повторял дед.| Она помнит.|
Проф. А. С. Лунин и акад. В. И. Реус спорят.| Пусть.|
Мешок стоит #,# руб. или больше.| Двух хватит.|
Он спросил: «Где мы?»| Никто не знал.| Подожди... может, придёт.| Поезд вышел в #.| Было темно.|
""",
    },
    "el": {
        "κήπος": """
Τα τριαντάφυλλα άργησαν.| Κανείς δεν τα κλάδεψε.| Κρίμα!|
Πάγωσαν τα φασόλια\u037e| Όχι.| Μεγαλώνουν πάλι.|
Ο κ. Δημητρίου και η κα. Λεμού μένουν εδώ.| Είναι γέροι.| Ο δρ. Άλκης έφυγε.|
Βλ. σελ. # και αρ. # του βιβλίου.| Τα άλλα περισσεύουν.|
Έχουμε σύκα, π.χ. Μαύρα ή λευκά, δηλ. πολλά.| Οι σφήκες έρχονται.|
Ρώτησε: «Πού είμαστε\u037e»| Κανείς δεν ήξερε.| Περίμενε... ίσως έρθει.| Το πλοίο έφυγε στις #.| Ήταν νύχτα.|
""",
    },
    "hi": {
        "बाग": """
इस साल गुलाब देर से खिले।| किसी ने छँटाई नहीं की।| अफ़सोस!|
क्या पाले से फलियाँ मर गईं?| नहीं।| वे फिर बढ़ रही हैं।|
"पानी दो। फिर से दो!" दादा यही कहते थे।| वह भूली नहीं।|
"उठो! सुबह हो गई।" माँ ने खिड़की खोली।| चिड़ियाँ चहक उठीं।| "डरो मत। मेरे साथ आओ।" बूढ़े ने धीरे से कहा।| बच्चा मान गया।|
"रुको! बारिश थमेगी।" माली आसमान देखता रहा।| बादल छँट गए।|
डॉ. वर्मा और श्री. लाल यहाँ रहते हैं।| वे बूढ़े हैं।|
पृ. # और क्र. # देखें।| बाकी ज़रूरी नहीं।|
माँ ने पूछा: "खाना बना?"| रसोई में कोई नहीं था।|
एक बोरी #.# रुपये की है; दो काफ़ी हैं।| महँगी है!|
""",
        "यात्रा": """
नाव भोर में चली।| घाट पर अँधेरा था।|
"किनारा!" की आवाज़ गूँजी।| सब दौड़े।| कप्तान बोला: "हम भटक गए। अब क्या करें?"| सब चुप रहे।|
गाड़ी # बजे छूटी।| रास्ता # किलोमीटर है।| रुको... हवा बदल गई।|
letter_#.txt और v#.# देखो।| द्वीप पर # लोग हैं।|
""",
    },
    "ar": {
        "حديقة": """
تأخر الورد هذا العام.| لم يقلمه أحد.| يا للأسف!|
هل قتل الصقيع الفول؟| لا.| إنه ينمو من جديد.|
"اسق. ثم اسق مرة أخرى!" كان أبي يردد.| لم تنس ذلك.|
"انهض! طلع الصباح." فتحت أمي النافذة.| غردت الطيور.| "لا تخف. تعال معي." همس الشيخ.| هز الطفل رأسه.|
يسكن د. سالم هنا.| هو عجوز.| انظر ص. # وج. # من الكتاب.| يكفي هذا.|
سألت الأم: "أين الطعام؟"| لم يجب أحد.|
ثمن الكيس #.# دينار، وكيسان يكفيان.| غال!|
""",
        "رحلة": """
أبحرت السفينة فجرا.| كان الميناء مظلما.|
"اليابسة!" دوى الصوت على السطح.| بكى البحارة.| قال القبطان: "ضللنا الطريق. ماذا نفعل؟"| سكت الجميع.|
بنيت المنارة عام #.| يسكن الجزيرة # شخصا.| انتظر... تغيرت الريح.| هبط السعر إلى #...| صمت.|
افتح letter_#.txt ثم v#.#.| انتهى.|
""",
    },
    "th": {
        "สวน": """
ปีนี้กุหลาบบานช้า| ไม่มีใครตัดแต่งกิ่ง| น่าเสียดาย!|
ถั่วตายหรือยัง| ยังไม่ตาย| มันโตขึ้นอีก|
ฝังเมล็ดลึก # เซนติเมตร แล้วรดน้ำ| ที่เหลือปล่อยให้ฝนช่วย|
ถุงละ # บาท ซื้อสองถุงก็พอ| แพงมาก|
ตาพูดว่ารดน้ำทุกวัน| ยายหัวเราะ| แมวนอนหลับ|
ส่งอีเมลทาง Gmail ทุกเช้า| เปิดเพลงจาก YouTube แล้วเต้น| ดื่ม Coca-Cola กับน้ำแข็ง| กินวิตามิน C วันละ # เม็ด| ดูทีวีช่อง BBC กับ CNN ทั้งคืน| ปลูก # ต้นใช้ปุ๋ย NPK กับดิน| ซื้อตู้เย็น LG ในห้าง|
""",
        "เดินทาง": """
เรือออกเวลา #.# น. ท่าเรือยังมืดอยู่| กลับถึงบ้าน #.# น. พอดี| ทุกคนเหนื่อย|
สร้างเมื่อ พ.ศ. # โดยชาวบ้าน| เกาะนี้มีคน # คน| ไม่มีสะพาน|
ขึ้นรถไฟขบวน # ไปเชียงใหม่| รถช้า # ชั่วโมง| ผู้โดยสารหลับ|
ดร. สมชาย เขียนจดหมาย| เปิดไฟล์ letter.txt ก่อน| ใช้ GPS กับแผนที่| ลมเปลี่ยนทิศ|
""",
    },
    "lo": {
        "ສວນ": """
ປີນີ້ດອກກຸຫຼາບບານຊ້າ| ບໍ່ມີໃຜຕັດກິ່ງ| ໜ້າເສຍດາຍ!|
ຝັງເມັດເລິກ # ຊັງຕີແມັດ| ທີ່ເຫຼືອໃຫ້ຝົນຊ່ວຍ| ແມວນອນຫຼັບ|
ເຮືອອອກ # ໂມງ| ທ່າເຮືອຍັງມືດ| ທຸກຄົນເມື່ອຍ|
""",
    },
    "km": {
        "សួន": """
ឆ្នាំនេះ ផ្កាកុលាបរីកយឺត។| គ្មាននរណា កាត់មែកទេ។| គួរឲ្យស្តាយ!|
តើសណ្តែកងាប់ហើយឬ?| មិនទាន់ទេ។| វាដុះឡើងវិញ។|
កប់គ្រាប់ជម្រៅ # សង់ទីម៉ែត្រ រួចស្រោចទឹក។| ទុកឲ្យភ្លៀងជួយ។|
ទូកចេញនៅម៉ោង #។| កំពង់ផែនៅងងឹត។| មនុស្សទាំងអស់ ហត់នឿយ។|
""",
    },
    "my": {
        "ဥယျာဉ်": """
ဒီနှစ် နှင်းဆီပန်း နောက်ကျပွင့်သည်။| ဘယ်သူမှ အကိုင်းမဖြတ်ပါ။| နှမြောစရာပဲ!|
ပဲပင် သေပြီလား။| မသေသေးပါ။| ပြန်ပေါက်နေသည်။|
အစေ့ကို # စင်တီမီတာ မြှုပ်၍ ရေလောင်းပါ။| ကျန်တာ မိုးကူမည်။|
လှေသည် # နာရီတွင် ထွက်သည်။| ဆိပ်ကမ်း မှောင်နေသည်။| လူအားလုံး မောပန်းသည်။|
""",
    },
}
