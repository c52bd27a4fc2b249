"""The small labelled table that the personal-information model is trained from.

Each pattern is a sentence or a block with its labels in braces; `rows` fills them from generators with a fixed seed,
so that shapes, not words, are learnt. Names are made of syllables or taken from the given people.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

# <t> a time stamp. {n} person, {t} family name only, {e} email, {p} phone, {i} identity number, {a} {ad} {af} {as} {az} {aj} {ai} {an} {ar} street address;
# {nd} {na} {nz} {nj} {nk} {nt} {nr} {ng} a person in Devanagari, Arabic, Chinese, Japanese, Korean, Thai, Cyrillic, Greek letters.
# <w> a common noun, <c> a capitalised word, <d> digits, <x> an untagged name-like word, <h> hex digits.
PATTERNS = """
Please send the corrected captions to {e} before noon.
Write to {e} or {e}, whichever answers first.
{e} bounced, try {p}
{e} bounced, try {e}
You can reach me at {p} after six.
I called {p} twice, nobody from subtitling answered.
Mr. {n} will pick up the tapes; his number is {p}.
Ms. {n} will bring the drives; her number is {p}.
For the payroll form we need {i} and {p}.
phone {p}
T: {p}
tel. {p} / {e}
Tel: {p}, fax {p}
Mobile {p}
{p}
From: {n} <{e}>\\nSubject: captions <d>, <w>\\n\\nHello,
From: {n} <{e}>\\nTo: {n} <{e}>\\nSubject: captions <d>, <w>
Contact: {n} <{e}>
Contact: {n} <{e}> and {p}
Best regards,\\n{n}\\n{a}\\nT: {p}
Best regards,\\n{n}\\nT: {p}
-- \\n{n}\\n{a}
-- \\n{n}\\n{p}
-- \\n{n}\\n{e}
Best regards,\\n{n}
Thanks\\n{n}
Thanks\\n{n}\\n{p}
Cheers\\n{n}
Regards\\n{n}\\n{a}
Best regards,\\n{n}\\n{ad}\\nphone {p}
Thanks\\n{n}\\n{af}\\nphone {p}
Best regards,\\n{n}\\n{as}\\nT: {p}
-- \\n{n}\\n{az}\\n{p}
Thanks\\n{n}\\n{aj}\\n{p}
-- \\n{n}\\n{ad}
-- \\n{n}\\n{af}
Best regards,\\n{n}\\n{as}
Thanks\\n{n}\\n{az}
-- \\n{n}\\n{a}\\n{p}
Thanks,\\n{n}\\nphone {p}
{n}\\n{a}\\n{e}
{n}
{a}
Deliver to: {n}; {a}; {p}
Drop the drives at {a} and ring twice.
The invoice goes to {n}, {a}.
{n} moved to {a} last spring.
Our office is at {a}.
She lives at {a}, next to the mill.
Tax ID {i} (on file for {n}).
Her passport no. is {i}, the courier will ask for it.
His passport number is {i}.
our interpreter {n} still has no badge (ID: {i})
SSN {i}, as on the form.
National ID {i} was checked.
Signed, {n}
Translated by {n}, checked by {n}.
Narrated by {n}.
My name is {n} and I sync the second reel.
I am {n} from the archive.
"Is it <w>?" asked {n}.
"It is gone," said {n}.
"Is it <w>?" asked {n}.\\n{n} signed for the <w> (see p. <d>), didn't they?
"Is it <w>?" asked {n}. Mr. {t} and Mrs. {t} left the <w> at <d>.<d> in the morning.
Translated by {n}, checked by {n}. Well... the <w> is quiet, isn't it?
Signed, {n}\\n> Drop the drives at {a} and ring twice.
{n} has the <w>, the map, the keys, etc.
{n} and {n} left the <w> at <d>.<d> in the morning.
Mr. {t} and Mrs. {t} left the <w> at <d>.<d> in the morning.
Mrs. {t} said so.
Capt. {t} of the ferry paid $<d>.<d> for a <w>.
Ask Sgt. {t} about the <w> at <d> a.m.
Ask Sgt.\\n{t} about the <w> at <d> a.m.
{n} signed for the <w> (see p. <d>), didn't they?
The <w>, e.g. the one Prof. {t} built, is quiet again.
The <w>, e.g. the one\\nProf. {t} built, is <w> again.
Dr. {t} asked whether the <w> could be moved to the studio.
[00:<d>:<d>] SPEAKER <d>: {n} has the <w>, the map, the keys, etc.
[00:<d>:<d>] SPEAKER <d>: Mr. {t} and Mrs. {t} left the <w> at <d>.<d> in the morning.
[00:<d>:<d>] SPEAKER <d>: You can reach me at {p} after six.
[00:<d>:<d>] SPEAKER <d>: "Is it <w>?" asked {n}.
> {n} signed for the <w> (see p. <d>), didn't they?
- {n} has the <w>, the map, the keys, etc.
Bitte senden Sie die Untertitel an {e}.
Rückruf: {p} oder {e}
Sie erreichen Frau {n} unter {p}.
Sie erreichen Herrn {n} unter {p}.
Frau {t} kommt später, Herr {t} auch.
Mein Name ist {n}, ich schneide die zweite Rolle.
Ausweis-Nr. {i}, ausgestellt für {n}.
Steuer-ID {i}, ausgestellt für {n}.
Die Bänder gehen an {ad}, zu Händen von {n}.
Wir wohnen jetzt in der Nähe, {ad}.
Die Adresse lautet {ad}.
Dr. {t} fragte, ob z. B. die Tonspur fehlt.
Für {n} war die Kamera zu leise, für uns natürlich nicht.
Herr Dr. {t} ist krank.
Merci d'envoyer les sous-titres à {e}.
Vous pouvez joindre Mme {n} au {p}.
Vous pouvez joindre M. {n} au {p}.
Tél. {p}, courriel {e}
Je m'appelle {n} et je relis les dialogues.
N° de sécurité sociale : {i} ({n}).
Livrez les bandes au {af}.
L'adresse est {af}, merci.
M. {t} a posé la caméra près du port.
M.\\n{t} a posé le micro près du studio.
Mme {t} n'a rien dit pendant <d> minutes.
Envíe los subtítulos a {e}, por favor.
Llame a {n} al {p} antes de las ocho.
Tel. {p} o correo {e}
Me llamo {n} y reviso los diálogos.
DNI {i}, a nombre de {n}.
NIE {i}, a nombre de {n}.
Entregue las cintas en {as}.
La dirección es {as}.
El Sr. {t} llegó a las <d>.<d> con la Sra. {t}.
Ο κ. {tg} έφυγε νωρίς.
डॉ. {th} ने टेप ठीक किया।
请把字幕发到{e}，谢谢。
联系人{n}，电话{p}。
有事请找{n}。
联系人{n}，电话{p}。谢谢。
有问题请拨打{p}联系录音棚。
我的邮箱是{e}，地址是{az}。
硬盘请寄到{az}。
身份证号：{i}，仅用于入场登记。
字幕データは{e}までお送りください。
お問い合わせは{p}へどうぞ。
テープの送付先は{aj}です。
担当の{n}（{p}）に連絡してください。
個人番号は{i}です。
担当は{n}です。
担当の{n}（{p}）まで。
"""
NEGATIVES = """
Pass user@host style strings to the burn step as plain text.
@captions-team please re-run job <h>.
Checksum <h> does not match track <d> at 44100 Hz.
Order code LX-<d>-<d>-7 has 12 Angry Lamps as working title.
Frame 206-555 drifts by two frames, frame 555-01<d> by three.
Build 3.<d>.<d>.206.555 of the aligner fails on cue 07700.
Ratio 16:9, bitrate 4400-9000, 2026-03-<d> draft.
The reel "Golden Harbour at Dusk" was shot on Lantern Street, somewhere off the market.
The reel "Golden Harbour at Dusk" was shot on Quarry Road.
Timecode 00:<d>:<d>,500 --> 00:<d>:<d>,140 overlaps.
QC report for m0000<d>: <d> cues, <d> major, max_cps=<d>
cue <d>: too_short_duration (<d> ms, <d>.<d> cps)
- cue <d>: line_too_long (<d> ms, <d>.<d> cps)
# m000004<d> / transcript (en)\\n\\n[00:00:<d>] SPEAKER 1: Yes. Really?!
2026-03-11T16:24:00Z WARN worker-<d> job=<h> wrote /data/jobs/<h>/out.fixed.srt
2026-04-18T13:15:00Z WARN worker-<d> job=<h> asr device=cpu
## Speaker labels
## Reading speed
## Line length\\n\\nIt took approx. <d> minutes, i.e. longer than anyone had planned.
The <c> said the file is at https://files.invalid/reel.<d>.<d> and went home.
See https://media.example/<h><h>.
<d>\\n00:01:24,329 --> 00:01:28,664\\nThe level rose by <d>.<d> percent in <d> days!
<d>\\n00:<d>:24,329 --> 00:01:28,664\\n“Leave the ledger here!” shouted the editor, and nobody did.
"Are you sure? I am not," said the <w>.
There are <d> lamps in the old mill and only <d> of them work.
Open cue No. <d> in build v4.0.<d> and compare it with fig. <d>.
Lot no. <d> vs. lot no. <d>, that's the whole argument.
The memo from Jan. <d> says fig. <d> shows the quarry at approx. <d>.<d> m.
Reel <d> ends here; the editor wants <d> more.
We meet the projectionist at <d> p.m.
At <d>:<d> the narrator read the <d>.<d> kg label aloud, but nobody answered.
You have no idea how quiet the studio looks after <d> hours of rain, do you?
Somebody left a dry suitcase and a tripod behind the cellar, so the archivist locked the door at 1:13.
She works for the Q.R.V. archive near the cutting room.
Don't touch the camera before the sound engineer is back from the station.
May I see the <w>? Will you mark it? Hope so.
Mark the cue. Grant access. Rose petals fell at dawn.
In May the lamp was Frank's idea of a joke, will you ask?
<t> INFO worker-<d> job=<h> asr device=cpu compute=int8
<t> WARN worker-<d> job=<h> quality pass 2 not ok
<t> ERROR worker-<d> job=<h> cut <d> segments, 2<d> words\\n<t> INFO worker-<d> job=<h> Ratio 16:9, bitrate 4400-9000, 2026-03-<d> draft.
<t> WARN worker-<d> job=<h> cut <d> segments\\n<t> WARN worker-<d> job=<h> wrote /data/jobs/<h>/out.fixed.srt
<d>\\n00:<d>:24,329 --> 00:01:28,664\\n(The tripod is still ready.)\\nReally?!
<d>\\n00:<d>:24,329 --> 00:01:28,664\\n<i><w></i>
"max_cps": <d>, "min_dur_ms": 9<d>, "worker_id": "worker-<h>"
Wait... Yes. Well... the <w> is quiet, isn't it? Really?!
Yes.\\nWait...\\nNot now!\\nYes.
He whispered, "The <w> is gone." (The <w> is still ready.) I thought... maybe the <w> was never dry.
- Wait...\\n- I thought... maybe the <w> was never frozen.
The <w> near the <w> is too loud, and the captain knows it. Who moved the <w>?
Don't touch the <w> before the narrator is back from the quarry. Not now! The <w> was frozen when we reached the harbour.
It took approx. <d> minutes, i.e. longer than anyone had planned.\\nYes. The label reads “Keep dry. Do not open.” and nothing else.
The slate reads 🎬🎬🎬 today, not 🎞️. The level rose by <d>.<d> percent in <d> days!
Я не знаю... может быть, завтра.\\nВозьми лампы, кабели и т. д. Мы ждали <d> мин. у старой студии. Да. Правда?!
«Кто там? Я ничего не слышу», — сказал монтажёр. См. рис. <d> на стр. <d>, там всё подписано. Почему запись опять не работает?
Δεν ξέρω... ίσως αύριο. Ο ήχος ανέβηκε κατά <d>,<d> τοις εκατό.\\nΠεριμέναμε <d> λεπτά στον σταθμό. «Σταμάτα!» φώναξε ο σκηνοθέτης και έφυγε.
Χθες στις <d>:<d> χάθηκε η κάμερα στο λιμάνι. Ναι.
كان الشريط في المخزن منذ <d> يومًا. أين النص؟ ارتفع الصوت بنسبة <d>.<d> في المئة.
انتظرنا <d> دقيقة عند المحطة.\\nوجدنا المصباح في القبو، ولم يصدقنا أحد. حسنًا. هل رأيت الشريط قرب الميناء؟
وصل المخرج في الساعة <d>:<d> ومعه النص. قال المخرج: «توقفوا!» ثم غادر.
<d>\\n00:<d>:24,329 --> 00:01:28,664\\nكان الكاميرا في المخزن منذ <d> يومًا.
글쎄요... 아마 지도 문제일 겁니다. “멈춰!” 하고 감독이 외쳤다. 네. 정말요?! 녹음실까지 <d>.<d>킬로미터 남았습니다.
네. 어제 창고 근처에서 카메라 찾았지만 이제 쓸 수 없습니다. 자막 어디에 있습니까? “빨리요! 더 빨리요!” 하고 조감독이 말했다.
เสียงดังขึ้น <d>.<d> เปอร์เซ็นต์ค่ะ พรุ่งนี้เวลา <d>.<d> น. เจอกันที่โกดังนะคะ แผนที่อยู่ที่ไหนคะ ไปกันเถอะครับ
เรารอที่ท่าเรือ <d> นาทีครับ\\nผู้กำกับบอกว่าม้วนเทปหนัก <d>.<d> กิโลค่ะ เมื่อวานนี้มีคนเอาแผนที่ไปที่โกดัง แต่ไม่มีใครเห็นครับ
निर्देशक ने <d>.<d> किलो का नक्शा उठाया और चला गया। उसने कहा, “माइक यहाँ नहीं है।” टेप कहाँ है? आवाज़ <d>.<d> प्रतिशत बढ़ी।
हमने स्टेशन पर <d> मिनट इंतज़ार किया।\\nठीक है। रुको!
“快点！再快一点！”场记催促道。他问：“几点了？”没有人回答。真的吗？！别急。好的。我想……也许是剧本的问题。你把旧地图放在哪里了？
「早く！もっと早く！」と助監督が言った。えっと……たぶん字幕です。「レンズが壊れた。」と彼は言った。急いで！本当に？！
Yes. Somebody left a dry suitcase and a camera behind the quarry.
Hi team,
Hello,
To whom it may concern,
Best regards,
Subject: captions <d>, <w>
I thought... maybe the <w> was never <w>.
Das kostet <d>.450 Kronen, nicht wahr?
Die Crew prüfte am <d>. Dezember die Tonspur im Hafen.
Am <d>. Mai fehlten <d>,<d> Meter Film, d. h. fast die ganze Szene.
Die Lampe steht seit <d> Tagen im Keller, und niemand holt sie ab.
Die Aufnahme Nr. <d> ist u. a. wegen des Windes unbrauchbar.
Sie sagte: „Die Klappe ist leer.“ Treffen wir uns um <d>.<d> Uhr am Gewächshaus?
„Halt!“, rief die Technikerin und lief zum Hafen.
Es dauerte ca. <d> Minuten bzw. <d>,<d> Stunden. Schön. Nein!
Hier endet die Liste der Kabel, Lampen, Stative usw. Wer hat das Licht im Studio ausgemacht?
Le monteur a dit : « C'est terminé. » Très bien ! D'accord.
Voir p. <d>, éd. révisée, pour la liste complète. Où est passée la bande no <d> ?
C'est env. <d>,<d> % de trop, c.-à-d. presque rien. Qui a déplacé le micro ?
« Attendez ! » cria le preneur de son avant de partir. Je ne sais pas... peut-être demain au port.
Après <d> jours de pluie, la caméra était enfin prête au phare.
«¡Silencio!», gritó la directora, y todos callaron. ¿Dónde está la cinta n.º <d>?
La señal bajó <d>,<d> puntos en <d> días. Se tarda aprox. <d> minutos, p. ej. con lluvia.
Ella dijo: «Aquí está la lámpara.» Traiga cables, focos, pilas, etc. ¡Corten! Sí.
¿Quién movió el guion, señor técnico? Nadie vio la cinta después de la función en el molino.
«Стой!» — крикнул оператор и убежал. Где плёнка № <d>? Это было в <d> г. на съёмках у моста.
Вчера у мельницы нашли <d> плёнок, но ни одна не подошла. Новая карта стоит <d>,<d> тыс. крон.
Ποιος πήρε τα <d> κλειδιά; Πού είναι η ταινία; Ναι. Το κτίριο κ.λπ. κόστισε <d>,<d> εκατ. κορώνες.
ठीक है। रुको! कल <d> बजे माइक फिर से खराब हो गया।
第<d>场的灯具（见图<d>.<d>）已经修好了。我们在山谷等了<d>分钟。误差是<d>.<d>%，版本号为v3.7.24。
请在1:38以前把片头送到剪辑室，不要忘记带上备用电池。《雾中的胶片！》是一部老片，时长<d>分钟。
昨天晚上录音棚的风很大，旧地图被吹倒了两次，大家都没有睡好。她说：“灯具不见了。”
第<d>話のテープは倉庫に置いてあります。港で<d>分待ちました。誤差は<d>.<d>％でした。
彼女は「もう終わった」と言い、橋のたもとへ向かった。昨日の字幕は、あまりにも暗くて、灯台では何も見えませんでした。
3시 26분까지 대본 준비해 주세요. 값은 <d>.<d>퍼센트입니다. 편집실에서 <d>분 동안 기다렸습니다.
"""
# Sentences and blocks of other kinds than those above: what people write in mails, forms, chats and notes anywhere.
MORE = """
Is there a way to get hold of {n} before the weekend?
Yesterday {n} and {n} went over the budget with us.
We have never met {n}, who lives at {a}.
{n} will join us on Monday.
Has anyone heard from {n} lately?
According to {n}, the bridge opens in <d> weeks.
The doctor, {n}, told us to wait.
My neighbour {n} can be reached on {p} or by mail at {e}.
Many thanks to {n} for the photographs.
Thank you, {n}, for your letter of <d> March.
Dear {n},
Dear Mr {t},
Dear Ms. {t},\\nthank you for your call.
Hi {n}, could you look at this?
Hello Mrs {t}, your parcel is ready.
Mr {t} phoned again.
Mr. {t} asked for a receipt.
Miss {t} teaches piano on Thursdays.
Professor {t} reads the first chapter.
Captain {n} sailed at dawn.
I met Dr {n} at the clinic.
written by {n}
Author: {n}
Reviewer: {n}, {e}
Name: {n}\\nAddress: {a}\\nPhone: {p}\\nEmail: {e}
Full name: {n}\\nPassport: {i}\\nMobile: {p}
Customer: {n} ({e})
Patient {n}, born <d>.<d>.19<d>, insurance number {i}
Attn: {n}\\n{a}
Ship to:\\n{n}\\n{a}
Billing address: {a}
Return address: {n}, {a}
Cc: {n} <{e}>
To: {e}
Reply-To: {e}
From: {n} <{e}>
Sincerely,\\n{n}\\n{p}
Yours,\\n{n}
Kind regards\\n{n}\\n{e}
With best wishes,\\n{n}\\n{a}\\n{e}\\n{p}
Love, {n}
~ {n}
{n}\\n{p}
{n}\\n{e}
{n}, {p}
{n} ({p})
{n} | {e} | {p}
- {n}: {p}
* {n}, {a}
1. {n} - {e}
{n} wrote:
On Monday {n} <{e}> wrote:
Questions? Ask {n} at {p}.
Text me on {p} when you arrive.
WhatsApp {p}
Our hotline is {p}, day and night.
Fax: {p}
Ring {p} and ask for {n}.
Call {p} now, it is urgent.
Phone number: {p}
Landline {p}, mobile {p}
My new number is {p}, please note it.
If nobody answers, dial {p}.
The night porter has the number {p}.
Emergency contact: {n}, {p}
Send the invoice to {e} and a copy to {e}.
You will find me under {e}.
My address for mails is {e}.
E-mail: {e}
mail me: {e}
Registered with {e} on <d> June.
Contact {e} for access.
owner={e} state=open
user {e} logged in
<t> INFO mail sent to {e}
<t> INFO worker-<d> job=<h> submitted_by={e}
<t> WARN login of {e} refused
mailto:{e}
The account {e} is locked.
Her social security number is {i}.
His tax number, {i}, was missing.
Tax number {i}
Passport number: {i}
Passport {i} expires in <d> months.
The bearer of passport {i} is {n}.
ID card {i}
ID number {i} does not match.
Please state your national identity number ({i}).
Identity card no. {i} of {n}
Driving licence {i}
SSN: {i}
Insurance no.: {i}
We copied the id, {i}, from the form.
Visa for {n}, passport {i}, granted.
Employee {n} (tax ID {i}) starts in May.
We met at {a} for lunch.
They live in a flat at {a}.
He was born at {a}, a small house by the river.
The parcel was left at {a}.
The shop at {a} closes at <d>.
Come to {a} at <d> p.m.
Meet me in front of {a}.
Address: {a}
My address is {a}.
Office: {a}
Location: {a}
Visit us: {a}
From {a} it is <d> minutes on foot.
Pickup at {a}, drop-off at {a}.
She lives at {a}.
The fire at {a} was put out by noon.
Wohnhaft in {ad}.
Ich wohne in der {ad}.
Adresse: {ad}
Unser Büro: {ad}
Treffpunkt ist {ad}, um <d> Uhr.
Liefern Sie bitte an {n}, {ad}.
Sehr geehrte Frau {t},
Sehr geehrter Herr {t},
Lieber {n}, danke für den Brief.
Mit freundlichen Grüßen\\n{n}\\n{ad}
Viele Grüße\\n{n}\\n{p}
Telefon: {p}
Tel.: {p}
Ruf mich an: {p}
Meine Nummer ist {p}.
Reisepass {i}
Personalausweis {i}, gültig bis <d>.
Steuernummer: {i}
J'habite au {af}.
Adresse : {af}
Rendez-vous au {af} à <d> h.
Chère Madame {t},
Cher {n},
Cordialement,\\n{n}\\n{af}
Bien à vous,\\n{n}
Téléphone : {p}
Appelez-moi au {p}.
Passeport n° {i}
Le passeport {i} appartient à {n}.
Numéro fiscal {i}
Vivo en {as}.
Dirección: {as}
Nos vemos en {as} a las <d>.
Estimado señor {t}:
Querida {n}:
Un saludo,\\n{n}\\n{as}
Saludos\\n{n}
Teléfono: {p}
Mi móvil es {p}.
Pasaporte {i}
Mi DNI es {i}.
Con documento {i} se presentó {n}.
Abito in {ai}.
Indirizzo: {ai}
L'ufficio è in {ai}.
Gentile {n},
Cordiali saludos,\\n{n}\\n{ai}
Ik woon aan de {an}.
Adres: {an}
De winkel zit op {an}.
Met vriendelijke groet,\\n{n}\\n{an}
Я живу по адресу: {ar}.
Адрес: {ar}
Посылку доставили на {ar}.
Меня зовут {nr}, я монтирую вторую часть.
Звоните {nr} по телефону {p}.
Паспорт {i} выдан на имя {nr}.
Уважаемый {nr}!
Вчера {nr} и {nr} были на складе.
С уважением,\\n{nr}
Με λένε {ng} και είμαι από το αρχείο.
Η {ng} έφυγε χθες.
Τηλέφωνο: {p}, {ng}
मेरा नाम {nd} है।
{nd} ने कल फोन किया।
कृपया {nd} से {p} पर बात करें।
कल {nd} और {nd} स्टूडियो आए थे।
डॉ. {nd} छुट्टी पर हैं।
اسمي {na} وأعمل في الأرشيف.
اتصل بالسيد {na} على الرقم {p}.
قال {na} إن الشريط في المخزن.
وصلت {na} إلى الميناء أمس.
我叫{nz}，负责第二卷。
请联系{nz}，电话{p}。
{nz}昨天来过片场。
导演{nz}说可以开始了。
收件人：{nz}，{az}
我是{nz}。
私の名前は{nj}です。
{nj}さんに電話してください：{p}
監督の{nj}さんが来ました。
{nj}様
제 이름은 {nk}입니다.
{nk} 씨에게 {p}로 전화해 주세요.
감독 {nk} 씨가 창고에 왔습니다.
저는 {nk}이고 녹음을 맡고 있습니다.
ผมชื่อ{nt}ครับ
กรุณาติดต่อคุณ{nt}ที่ {p} ค่ะ
คุณ{nt}มาถึงโกดังแล้วค่ะ
"""
# <j> and <z> what joins two of a kind, <q> labels of other codes, <k> such codes, <m> a title, <g> a farewell, <v> what people do, <P> <I> <A> <E> <N> labels of fields.
MORE += """
{p}<j>{p}
call {p}<j>{p} today
<P>{p}<j>{p}
Our numbers are {p}<j>{p}.
{e}<j>{e}
mail {e}<j>{e}, please
<E>{e}<j>{e}
We use {e}<j>{e} for this.
{a}<j>{a}
between {a}<j>{a}
<A>{a}<j>{a}
They have <w>s at {a}<j>{a}.
{n}<j>{n}
with {n}<j>{n}<j>{n} in the <w>
<N>{n}<j>{n}
Only {n}<j>{n} <v> the <w>.
{i}<j>{i}
<I>{i}<j>{i}
{n}<j>{p}
{p}<j>{n}
{e}<j>{p}
{p}<j>{e}
{a}<j>{n}
{n}<j>{a}
{ad}<j>{n}
{as}<j>{n}
{af}<j>{p}
{nz}<z>{nz}
{nz}<z>{nz}在剪辑室。
{nj}<z>{nj}
{nj}<z>{nj}が来ました。
{nk}<z>{nk}
{nk}, {nk} 씨가 왔습니다.
คุณ{nt} และคุณ{nt}
คุณ{nt}กับ{nt}มาแล้ว
<m> {t} <v> again.
<m> {t} <v> the <w>.
<m> {n} <v> on Thursdays.
<m> {t} and <m> {t} <v> the <w>.
Yesterday <m> {t} <v> a <w>.
Dear <m> {t},
Good morning <m> {t},
I spoke to <m> {t} about the <w>.
The <w> belongs to <m> {n}.
{n} <v> the <w>.
{n} <v> again.
{n} and {n} <v> the <w>.
Then {n} <v> the <w> for us.
The <w> that {n} <v> is gone.
We gave {n} the <w>.
She and {n} <v> it.
A friend, {n}, <v> the <w>.
The <w>, said {n}, was quiet.
with {n} and <m> {t}
for {n}, not for {n}
{n}'s <w> is <d> years old.
<g>\n{n}
<g>,\n{n}
<g>,\n{n}\n{a}
<g>\n{n}\n{a}\n{p}
<g>\n{n}\n{ad}\n{p}
<g>,\n{n}\n{af}
<g>\n{n}\n{as}\n<P>{p}
<g>\n{n}\n{ai}
<g>,\n<m> {n}\n{e}
<g>\n{n}\n<P>{p}\n<E>{e}
<g>,\n{n}\n{az}
<g>\n{n}\n{aj}
<P>{p}
<P>{p} or {p}
<P>{p} / {p}
<P>{p}, <E>{e}
<w>: <P>{p}
<P>{p} ({n})
the <w> of {n} (<P>{p})
<E>{e}
<E>{e}, <P>{p}
{e} or {e}
from {e} to {e}
try {e}, not {e}
<w> for {e}
<I>{i}
<I>{i}, <N>{n}
<I>{i} ({n})
{n}, <I>{i}
{n} (<I>{i})
the <w> with <I>{i} is lost
<I>{i} expires in <d> months.
We noted <I>{i} and the <w>.
<N>{n}
<N>{n}, <I>{i}
<N>{n}, <A>{a}
<A>{a}
<A>{ad}
<A>{af}
<A>{as}
<A>{ai}
<A>{an}
<A>{ar}
The <w> stood at {a} for <d> years.
Take the <w> to {a}.
the <w> from {a}, please
{n} lives at {a}.
{n}, {a}
{n}, {ad}
{n}, {af}
{n}, {as}
{n}; {a}; {p}; {e}
{a} or {a}?
{p} or {p}?
Le <w> est au {af}.
Der <w> steht in {ad}, bei {n}.
El <w> está en {as}, con {n}.
M. {t} <v>.
Señora {t}, el <w> está listo.
Monsieur {t} a appelé.
Madame {n} a signé.
Frau {n} hat angerufen.
Herr {t} hat den <w> geholt.
Señor {n} llamó a las <d>.
{nd} और {nd} ने <w> देखा।
यह {nd} का नक्शा है।
श्री {nd} कल आएंगे।
संपर्क: {nd}, {p}
{nr} и {nr} нашли карту.
Карту нашла {nr}.
Контакт: {nr}, {p}
التقيت {na} قرب الميناء.
السيد {na} في المخزن.
للتواصل: {na}، {p}
{nz}和{nz}在录音棚等。
姓名：{nz}
{nz}说灯坏了。
{nj}です。よろしくお願いします。
氏名：{nj}
{nj}さんと{nj}さんは港にいます。
이름: {nk}
{nk} 씨와 {nk} 씨는 항구에 있습니다.
{nk}입니다.
คุณ{nt}กับคุณ{nt}รอที่ท่าเรือครับ
ชื่อ {nt} โทร {p}
นาย {nt} ไม่มาค่ะ
{ng} και {ng} περιμένουν.
Ο {ng} βρήκε τον χάρτη.
Επικοινωνία: {ng}, {p}
"""
OTHER = """
<q><k>
<q><k> is late.
<q><k> drifts by <d>, <q><k> by <d>.
<q><k> by <d> frames
<q><k>, <q><k>
We lost <q><k> and <q><k>.
The <w> has <q><k>.
<q><k>: <w>, <d> m
<c> <k>
<t> INFO <q><k> done
see <q><k> (<c>)
<w> <k> / <w> <k>
<q><d><d><d><d><d>
<R>
<R>
<R>
<D>
<D>
<D>
The committee met on Monday and agreed on <d> points.
Meeting at <d>:<d> in Room <d>, bring your notes.
Open from Monday to Friday, <d>:00 to <d>:30.
Version 2.<d>.<d> was released on 2025-<d>-<d>.
Section <d>.<d>.<d> describes the Reading Speed.
The Blue Harbour and The Last Lantern are films.
Chapter <d>: The Old Mill
Figure <d> shows a Lantern Street in winter.
We walked along Harbour Road and then down to the sea.
Turn left at Mill Lane after <d> metres.
High Street was closed to traffic.
The total is 1,<d>4.<d> dollars, of which 2<d>.<d> are tax.
Invoice 2025-00<d><d>, order 99<d>12, batch B-<d>-44.
Serial number SN-<d>8812-<d>, model KX<d>00.
ISBN 978-3-16-14<d>410-0
Part no. 4471-<d>-<d>
Ticket #<d>817 was closed.
Reference: REF-<d>-2<d>-XK
Tracking 1Z99<d>W<d>0312345
Coordinates 48.<d>12, 16.3<d>9
IP 192.168.<d>.<d>, port 8<d>80
sha1 <h><h><h>
id=<h> size=<d>04 name=cut-<d>
<t> INFO worker-<d> job=<h> state=running progress=0.<d>
<t> INFO worker-<d> job=3<d>12<d>55<d>9 cut 3<d> segments, 2<d>73 words
<t> WARN worker-<d> job=9<d>50<d>11<d>4 Build 3.<d>.<d>.206.555 of the aligner fails on cue 07700.
<t> ERROR worker-<d> job=<d><d><d><d><d><d> state=running progress=0.<d>
<d><d>4178<d>309887<d>12 \\n<d>55718<d>3 \\n2<d>8 \\n7<d>95880186<d>97658
See the Annual Report <d>, page <d>.
Thanks for the quick reply.
Thank you all for coming.
Dear colleagues,
Dear Sir or Madam,
Hi all,
Good morning everyone!
Yours sincerely,
Kind regards from the whole team
Love from all of us
Sent from my phone
The sound department
Camera and Lighting
Speaker <d>: I think so.
SPEAKER <d>: Where is the <w>?
INT. MILL - NIGHT
Scene <d>, Take <d>
The Director asked for silence.
Somebody left a <w> in the <w>.
Nobody told the Editor about the <w>.
Only the Captain knows the way to Harbour Island.
Every Friday the North Mill Orchestra plays.
Das Gewächshaus am Hafen ist geschlossen.
Für uns war der Film zu lang.
Die Hauptstraße ist gesperrt.
Am <d>. Mai fehlten <d>,<d> Meter Film.
La rue du Port est fermée pendant <d> jours.
La calle Mayor está cerrada.
Sehr geehrte Damen und Herren,
Madame, Monsieur,
Estimados señores:
Уважаемые коллеги!
Вчера на складе нашли <d> ламп.
我们昨天在仓库里找到了灯。
导演说可以开始了。
監督が来ました。
감독이 창고에 왔습니다.
ผู้กำกับมาถึงโกดังแล้วค่ะ
निर्देशक ने कल फोन किया।
وصل المخرج إلى الميناء أمس.
"""
# Common names of other scripts: first parts, last parts, what may stand between them.
_FOREIGN = {
    "nd": ("प्रिया अनिल सुरेश कविता दीपक मीना राजेश नेहा विकास सीमा मिरुका वेलिका", "शर्मा वर्मा गुप्ता सिंह पटेल जोशी मेहता नायर तरुवेन ओस्तवाल", [" "]),
    "na": ("محمد علي فاطمة سامي ليلى مراد نادر هالة ريم عمر كريم سلمى", "علي حداد نصار الكرمي البستاني منصور الخطيب صالح عباس", [" ", " ", " بن "]),
    "nz": ("王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙", "小明 伟 秀英 丽 建国 静 志强 海燕 晓东 敏 文博", ["", "", "", " "]),
    "nj": ("佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤", "健 美咲 翔太 由美子 一郎 さくら 大輔 恵子", ["", " "]),
    "nk": ("김 이 박 최 정 강 조 윤 장 임", "민수 지은 서준 하늘 영희 도윤 수빈 태호", ["", "", " "]),
    "nt": ("สมชาย สมหญิง วิชัย มานี ปรีชา สุดา อนันต์ กมล", "ใจดี ทองดี แสงทอง ศรีสุข วงศ์ไทย บุญมี", [" "]),
    "nr": ("Анна Иван Мария Пётр Ольга Дмитрий Елена Сергей Вера Олег", "Соколова Морозов Лебедева Кузнецов Белова Громов Орлова Зайцев", [" "]),
    "ng": ("Μαρία Νίκος Ελένη Γιώργος Άννα Κώστας", "Καρμέρης Θαμίρη Παπαδάκη Οσταβάλης Σορνίδη Βελαντρή", [" "]),
}
_PLAIN = {
    "j": " or | and |, |; | / | & |, then |, or | oder | und | ou | et | y | o |\n| - |, also | (also ",
    "z": "和|、|与|，|, | | と",
    "q": "Invoice |invoice no. |Order |order no. |Part no. |Serial |Batch |Ref. |Reference: |Ticket |Job |job=|Track |Build |Frame |Lot |Reel |cue |version |Model |ISBN |SKU |Room |Page |size=|id=|code |Order code |frames |frame |cue no. |drift |Film ",
    "m": "Mr|Mrs|Ms|Miss|Dr|Mr.|Mrs.|Ms.|Dr.|Prof.|Capt.|Sgt.|Prof|Professor|Captain|Lt.|Rev.|Sir|Mx.",
    "g": "Best regards|Kind regards|Regards|Thanks|Many thanks|Cheers|Sincerely|Yours sincerely|Yours|All the best|Best|With love|Mit freundlichen Grüßen|Viele Grüße|Cordialement|Bien à vous|Saludos|Un saludo|Cordiali saluti|-- |--",
    "v": "phoned|called|asked for|said|wrote|left|moved|found|signed|has|needs|will bring|brought|sold|lost|opened|closed|is looking for|was with|teaches|mended|joined|saw|never saw",
    "P": "Phone: |Tel.: |Tel. |T: |Mobile: |Mobile |phone |Cell: |Call |Ring |Fax: |Phone number: |Telefon: |Tél. : |Teléfono: |my number is |M |Text |or call |电话：|電話：|Тел.: ",
    "I": "ID: |Passport |Passport no. |SSN |SSN: |Tax ID |Tax number: |ID card |National ID |ID number |identity number |Reisepass |Steuernummer |Ausweis-Nr. |DNI |NIE |Passeport |N° fiscal |Pasaporte |CPF |PAN |passport |Паспорт |身份证号：|個人番号：",
    "A": "Address: |address |Office: |Location: |We live at |Deliver to |Our studio is at |It is at |Adresse: |Adresse : |Dirección: |Indirizzo: |Adres: |Адрес: |near |c/o ",
    "E": "Email: |E-mail: |email |mail |Mail: |write to |courriel |correo |reply to |E: ",
    "N": "Name: |name |Contact: |Attn: |Author: |Nom : |Nombre: |Kontakt: |signed by |by |for |c/o |Guest: |Client: ",
}
# Noise: letters, marks and pictures of many blocks.
_NOISE = [*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x391, 0x3CA), *range(0x400, 0x52F), *range(0x900, 0x970), *range(0x3041, 0x3097), *range(0x4E00, 0x9FA5, 7), *range(0xAC00, 0xD7A3, 7), *range(0x1F600, 0x1F640)]
_FAMILY = "Holt Stein Berg Costa Silva Lee Wong Khan Roy Cruz Santos Hassan Novak Rossi Weber Dubois Jansen Larsen Nagy Garcia Lopez Smith Brown Okafor Tanaka Schmidt Moreau Popov Haas Flynn".split()
_PARTICLES = ["de la", "de", "van", "van der", "von", "bin", "dos", "da", "di", "del", "de los", "ten", "le", "al"]
_PLACES = "Maple Oak Elm Cedar Hill Park Lake River Baker Church Station Queen King Bridge Garden Forest Rosen Linden Berg Brunnen".split()
_OTHER_KINDS = "Drive Blvd Boulevard Way Place Square Crescent Highway Parkway Hill".split()
NOUNS = "camera tripod radio ledger letter lantern script compass suitcase generator microphone projector quarry studio cellar harbour captain director editor archivist gaffer".split()
_ON = "Bren Tarn Quill Morv Ost Velk Sorn Grav Pell Zelk Rask Dask Kar Lor Ulv Holv Wint Istr Yarr Tham Brack Dunn Esk Farl".split()
_OFF = "strask quell moor vale ieri ová dottar enzel mere hault wyck burrow andrel éze aky ovith sen ley berg ton".split()
_GIVEN = ["".join((a, b)) for a in "Bri Qui Te Pe Ne Or Is Ol Gi Ha Ma Jo Vi Da Ru Lo El Ka Sa Fe Ta Mi Ro".split() for b in "sendra dran vien dric rith rrek lune lvo sha nna wyn bel mir lka tta zo ran lia".split()] + "May Will Hope Grant Rose Frank Dawn Mark Anna John Ali Juan Maria Vincent Charles Piet Ana Omar Sofia Lars Ines Noor Hans Eva Luc Ahmed Pedro".split()
_HOSTS = "box.test mail.example crew.test films.example post.invalid subs.example uni.brindle.example north-pier.example".split()
_STREETS = "Quarry|Heron|Candle|Alder|Lantern|Millrace|Old Tannery|Twelve Pines|Saint Orla's|North Mill|Harbour|Copper Bell".split("|")
_STREET_KINDS = "Street St. Road Rd Avenue Ave Lane Court Row Close Terrace Ave St. Street".split()
_TOWNS = "Brindleford|Osk Valley|Harrowmere|North Quell|Pellmoor|Tarnhaven|East Wick".split("|")


class _Fill:
    def __init__(self, seed: int, people: Sequence[tuple[str, str]]):
        self.r = random.Random(seed)
        self.people = sorted(people)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def shape(self, shape: str) -> str:
        """9 a digit, A a capital; the rest as it stands."""
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("０１２３４５６７８９") if c == "９" else self.r.choice("ABCDEHKLMNPRTXYZ") if c == "A" else c for c in shape)

    def family(self) -> str:
        r = self.r
        k = r.random()
        name = r.choice(self.people)[1] if self.people and k < 0.4 else r.choice(_FAMILY) if k > 0.88 else r.choice(_ON) + r.choice(_OFF)
        return name.upper() if r.random() < 0.1 else name

    def given(self) -> str:
        r = self.r
        return r.choice(self.people)[0] if self.people and r.random() < 0.4 else r.choice(_GIVEN)

    def person(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.1:  # a lower-case particle, or one that is part of the family name
            return f"{self.given()} {r.choice(_PARTICLES)} {self.family()}"
        if k < 0.12:
            return f"{self.given()} {r.choice(['O’', 'O\'', 'Mc', 'Mac', 'Al-', 'D\''])}{self.family().title()}"
        if k < 0.14:
            return f"{self.given()} {self.given()} {self.family()} {self.family()}"
        if k < 0.16:
            return f"{self.given()} {self.family()}-{self.family()}"
        first = r.choice(["{g}", "{g}", "{g}", "{g}", "{g}", "{g}-{g}", "{g} {I}.", "{I}.", "{I}.", "{I}. {I}."])
        while "{g}" in first:
            first = first.replace("{g}", self.given(), 1)
        while "{I}" in first:
            first = first.replace("{I}", r.choice("ABCDEFGHIJKLMNOPRSTVW"), 1)
        return f"{first} {self.family()}"

    def email(self) -> str:
        r = self.r
        g, f = r.choice(_GIVEN).lower(), (r.choice(_ON) + r.choice(_OFF)).lower().replace("é", "e").replace("á", "a")
        user = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}{r.randint(10, 99)}", f"{g[0]}{f}", f"{f}-{g}", f"{g}.{f}+subs", f"{g}.{f}.old"])
        host = r.choice(_HOSTS)
        k = r.random()
        if k < 0.1:
            return f"{user.upper()}@{host.title()}"
        if k < 0.17:
            return f"{user} @ {host}"
        if k < 0.24:
            return f"{user} [at] {host.replace('.', ' dot ')}"
        if k < 0.31:
            return f"{user} (at) {host.replace('.', ' [dot] ')}"
        if k < 0.36:
            return f"{user} at {host.replace('.', ' dot ')}"
        if k < 0.4:
            return f"{user}@\u200b{host}"
        return f"{user}@{host}"

    def phone(self) -> str:
        r = self.r
        shape = r.choice(
            "(415) 555-9999|415-555-9999|415.555.9999|415 555 9999|1-415-555-9999|+1 206 555 9999|+12065559999|718 555 9999 ext. 99|718-555-9999 ext. 999|206 555 9999 ext. 99|555 999 9999 ext. 9|415 555 9999 x99|（03）0055-9999|（０９）００５５－９９９９|+44 20 7946 9999|020 7946 9999|07700 900999|+44 (0)7700 900 999|+44 7700 900999|030 23125 999|030/23125-999|+49 (0)30 23125-999|+49 30 23125 99|"
            "01 99 00 99 99|01.99.00.99.99|0199009999|+33 1 99 00 99 99|+33 (0)6 39 98 99 99|000 551 999|000-551-999|000 55 99 99|(+34) 000551999|+34 000 551 999|03-0055-9999|090-0055-9999|+81 3 0055 9999|０９０－００５５－９９９９|１００－５５５０－９９９９|100-5550-9999|10055509999|+86 100 5550 9999|0990-55509999|+39 06 9999 9999|+7 (999) 999-99-99|8 (999) 999-99-99|+91 99999 99999|+31 20 999 9999|(999) 999-9999|999-999-9999|+1 999 999 9999|0699 999 99 99|+43 1 999 99 99|+61 2 9999 9999|010-9999-9999|02-9999-9999".split("|")
        )
        return self.shape(shape)

    def identity(self) -> str:
        return self.shape(self.r.choice("ZX9999999|ZX-9999-999|QX999999A|QX 99 99 99 A|666-99-9999|666 99 9999|99 999999 A 999|A99A9A99A|99999999-A|99.999.999-A|A-9999999-A|099139999999999|0 99 13 99 999 999 99|990155199999999999|99015519999999999X|0000 9999 9999|000099999999|99/999/99999|99999999A|99999999A|AA 99 99 99 A|A99999999|99-9999999|999-99-9999|9999999999|99AA99999|999.999.999-99|AAAAA9999A|9999 999999".split("|")))

    def address(self, kind: str) -> str:
        r, n = self.r, str(self.r.randint(1, 240))
        if kind in ("a", "ad") and r.random() < 0.12:  # houses with a stair or a letter
            n += r.choice([f"/{r.randint(1, 30)}", f"/{r.randint(1, 9)}/{r.randint(1, 30)}", "a", "B", f"-{r.randint(1, 30)}"])
        if kind == "a" and r.random() < 0.2:
            street = f"{r.choice(_PLACES)} {r.choice(_STREET_KINDS + _OTHER_KINDS)}"
            tail = r.choice(["", "", f", {r.choice(_PLACES)}ton", f", {r.choice(_PLACES)}, {r.choice(['TX', 'OR', 'NY', 'ON'])} {self.digits(5)}", f", Suite {self.digits(3)}", f" Apt. {r.randint(1, 30)}{r.choice('ABC')}", f", {r.choice(_PLACES)}ford {r.choice(['SW', 'NE', 'EC'])}{r.randint(1, 9)} {r.randint(1, 9)}{r.choice('ABD')}{r.choice('ABD')}"])
            return f"{n} {r.choice(['', '', '', 'N. ', 'West ', 'E '])}{street}{tail}"
        if kind == "ad" and r.random() < 0.3:
            return f"{r.choice(_PLACES)}{r.choice(['straße', 'str.', 'weg', 'gasse', 'platz', 'allee'])} {n}" + r.choice(["", f", {self.digits(4)} {r.choice(['Wien', 'Graz', 'Linz'])}", f", {self.digits(5)} {r.choice(['Bremen', 'Jena', 'Ulm'])}"])
        if kind == "ai":
            return f"{r.choice(['Via', 'Viale', 'Piazza', 'Corso'])} {r.choice(['dei Mulini', 'della Nebbia', 'Garibaldi', 'del Porto'])}{r.choice([',', ''])} {n}" + r.choice(["", f", {self.digits(5)} {r.choice(['Torre Alta', 'Portovale'])}"])
        if kind == "an":
            return f"{r.choice(_PLACES)}{r.choice(['straat', 'laan', 'gracht', 'weg'])} {n}" + r.choice(["", f", {self.digits(4)} {r.choice('ABCD')}{r.choice('ABCD')} {r.choice(['Molendam', 'Oostwijk'])}"])
        if kind == "ar":
            return f"{r.choice(['ул.', 'улица', 'пр.', 'пер.'])} {r.choice(['Садовая', 'Лесная', 'Мельничная', 'Речная'])}, {r.choice(['д. ', 'дом ', ''])}{n}" + r.choice(["", f", кв. {r.randint(1, 90)}"])
        if kind == "a":
            town = r.choice(_TOWNS)
            flat = r.choice(["", "", f", Flat {r.randint(1, 30)}", f", Unit {r.randint(1, 30)}", f", Apt {r.randint(1, 30)}"])
            end = r.choice(["", "", f", {town}", f", {town}", f", {town} 000{self.digits(2)}", f", {town}, 000{self.digits(2)}", f"\n{town} 000{self.digits(2)}", f"\n{town}, 000{self.digits(2)}"])
            return f"{n} {r.choice(_STREETS)} {r.choice(_STREET_KINDS)}{flat}{end}"
        if kind == "ad":
            street = r.choice(["Alter Dreschweg", "Lindgrabengasse", "Möwenstr.", "Am Mühlbach", "Tannenallee", "Fliederstraße", "Kupferplatz", "An der Weide"])
            return f"{street} {n}{r.choice(['', '', 'a', 'b'])}" + r.choice(["", f", 0999{self.digits(1)} {r.choice(['Brunnfelde', 'Morvstadt', 'Tannhusen', 'Oberquellau'])}", f", 0999{self.digits(1)} {r.choice(['Brunnfelde', 'Morvstadt'])}"])
        if kind == "af":
            street = r.choice(["rue des Aubépines-Grises", "impasse des Trois-Hérons", "avenue du Vieux-Phare", "bd de la Tour", "place du Marché-Bleu", "chemin des Lanternes", "quai de la Brume"])
            return f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice([',', ''])} {street}" + r.choice(["", f", 99{self.digits(3)} {r.choice(['Brenneville', 'Port-Velay', 'Saint-Orle'])}", f", 99{self.digits(3)} Brenneville"])
        if kind == "as":
            street = r.choice(["C/ de los Tejos Azules", "Calle de la Niebla", "Plaza de las Garzas", "Avda. del Faro Viejo", "Paseo de los Molinos"])
            return f"{street}, {n}{r.choice(['', '', ', 2.º B', ', 4.º izq.', ', piso 3', ', bajo', ', bajo'])}" + r.choice(["", f", 99{self.digits(3)} {r.choice(['Villagarza', 'Puerto Molino'])}", f", 99{self.digits(3)} Villagarza"])
        if kind == "az":
            return r.choice(["霁川市", "云梓市", "青岚县", "松塔市"]) + r.choice(["白鹭街", "铜灯路", "十二松大道", "旧港巷", "石桥路"]) + f"{n}号" + r.choice(["", "", f"{r.randint(101, 909)}室", f"{r.randint(1, 9)}单元{r.randint(101, 909)}室"])
        return r.choice(["霧沢市", "灯ヶ浜町", "松川市", "鷺ノ森区", "白ノ浜町"]) + r.choice(["青葉原", "銅燈町", "白鷺台", "桜木"]) + f"{r.randint(1, 9)}-{r.randint(1, 20)}-{r.randint(1, 20)}" + r.choice(["", "", f" 灯ビル{r.randint(101, 909)}号室"])

    def value(self, code: str) -> tuple[str, str]:
        if code == "n":
            return self.person(), "person_name"
        if code == "t":
            return self.family(), "person_name"
        if code in _FOREIGN:
            first, last, joint = _FOREIGN[code]
            return self.r.choice(first.split()) + self.r.choice(joint) + self.r.choice(last.split()), "person_name"
        if code == "tg":
            return self.r.choice("Καρμέρης Θαμίρης Βελαντρής Οσταβάλης Σορνίδης".split()), "person_name"
        if code == "th":
            return self.r.choice("मिरुका वेलिका तरुवेन ओस्तवाल रोहिका".split()), "person_name"
        if code == "e":
            return self.email(), "email"
        if code == "p":
            return self.phone(), "phone"
        if code == "i":
            return self.identity(), "id_number"
        return self.address(code), "street_address"

    def plain(self, code: str) -> str:
        r = self.r
        if code == "w":
            return r.choice(NOUNS)
        if code == "R":
            return "".join(chr(r.choice(_NOISE)) for _ in range(r.randint(10, 60)))
        if code == "D":
            return " \n".join(self.digits(r.choice([1, 2, 3, 5, 7, 8, 10, 12, 15, 17, 18, 24])) for _ in range(r.randint(3, 12)))
        if code == "k":
            return self.shape(r.choice("99-9999|999-9999|999-999|AA-999|9999999|A9999|99AA99|999.99.9|9999-99-99|AA-99-99-9|AAA999|9999999999|A-99-999|999/99|99999-999|AAA-9999-99|9999999999999".split("|")))
        if code in _PLAIN:
            return r.choice(_PLAIN[code].split("|"))
        if code == "c":
            return r.choice(NOUNS).title()
        if code == "t":
            return f"2026-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00Z"
        if code == "d":
            return str(r.randint(0, 9) if r.random() < 0.3 else r.randint(10, 99))
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12])))


def patterns() -> tuple[list[str], list[str], list[str]]:
    """The patterns with labels, further ones of other kinds, and those without labels."""
    labelled, more, one, other = ([p.replace("\\n", "\n") for p in x.split("\n") if p] for x in (PATTERNS, MORE, NEGATIVES, OTHER))
    return labelled, more, one + other


def filled(pattern: str, people: Sequence[tuple[str, str]], copies: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Fillings of one pattern, as it stands."""
    fill = _Fill(seed, people)
    return [_filled(pattern, fill) for _ in range(copies)]


def rows(people: Sequence[tuple[str, str]], copies: int = 16, seed: int = 5, without: frozenset[str] = frozenset()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, type)]) of `copies` fillings of each pattern but those left out; the size of the table does not depend on the data."""
    fill = _Fill(seed, people)
    r = random.Random(seed + 1)
    labelled, more, others = ([p for p in x if p not in without] for x in patterns())
    out = []
    for pattern, times in [(p, copies) for p in labelled] + [(p, max(1, copies * 3 // 4)) for p in more] + [(p, max(1, copies // 2)) for p in others]:
        for _ in range(times):
            # texts around: half of the rows stand among other sentences
            parts = [pattern]
            if "\n" not in pattern and len(pattern) > 20:
                if r.random() < 0.3:
                    parts.insert(0, r.choice(others))
                if r.random() < 0.3:
                    parts.append(r.choice(others))
                if r.random() < 0.15:
                    parts.append(r.choice(labelled + more))
            joint = r.choice([" ", "\n", " ", "\n", "\n- ", "\n• ", "\n> ", " \n", f"\n[00:00:{r.randint(10, 59)}] SPEAKER {r.randint(1, 4)}: ", f" [00:01:{r.randint(10, 59)}] SPEAKER {r.randint(1, 4)}: "])
            text, spans = _filled(joint.join(parts), fill)
            if r.random() < 0.2:
                mark = r.choice(["- ", "• ", "> ", "* ", "[00:01:17] SPEAKER 2: "])
                text, spans = mark + text, [(a + len(mark), b + len(mark), k) for a, b, k in spans]
            if r.random() < 0.12:  # a wrapped line
                blanks = [i for i, c in enumerate(text) if c == " " and 0 < i < len(text) - 1]
                if blanks:
                    i = r.choice(blanks)
                    text = f"{text[:i]}\n{text[i + 1 :]}"
            out.append((text, spans))
    return out


def _filled(pattern: str, fill: _Fill) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, i = "", [], 0
    while i < len(pattern):
        close = {"{": "}", "<": ">"}.get(pattern[i])
        end = pattern.find(close, i) if close else -1
        code = pattern[i + 1 : end] if end > 0 else ""
        if close == "}":
            value, kind = fill.value(code)
            spans.append((len(text), len(text) + len(value), kind))
            text += value
            i = end + 1
        elif close == ">" and (code in ("w", "c", "d", "h", "t") or code in _PLAIN or code in ("k", "R", "D")):
            text += fill.plain(code)
            i = end + 1
        else:
            text += pattern[i]
            i += 1
    return text, spans
